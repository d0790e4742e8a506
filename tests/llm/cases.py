"""Documents with every odd case at once, and plain-Python versions of what operators compute."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, items string, part int, row long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def documents():
    """Rows of SCHEMA: nulls everywhere, empty, blank and very long texts, copies, near copies, shared
    passages, repeated rows, and columns named like those that operators add."""
    rng = random.Random(7)
    base = words(rng, 120)
    passage = words(rng, 25)
    texts = {
        1: base, 2: base, 3: base.replace(base.split()[60], "zzz", 1), 4: words(rng, 300) + " " + passage,
        5: passage + "\n" + words(rng, 40), 6: None, 7: "", 8: " \n\t ", 9: "one two", 10: "One  TWO",
        11: words(rng, 20000), 12: "x" * 5000, 13: "Ünï çödé ß " * 30, 14: "\U0001F600 smile " + words(rng, 8),
        15: base + " tail words here", 16: None, 17: "", 18: "é" * 40, 19: passage, 20: "a" * 49,
    }
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "src0", len(t) if t else None, "kept", "items", 5, k)
            for k, t in texts.items()]
    rows.append(rows[0])                       # a repeated row
    rows.append((None, base, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def components(rows, width=5, percent=80):
    """(id, set size, smallest linked id) per row, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None))
            for i, (d, _) in enumerate(rows)]


def repeats(rows, length=50):
    """(id, bytes, removed, spans, digest of the rest) per row."""
    least = {}
    order = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in order:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            least[w] = min(least.get(w, float("inf")), d)
    out = []
    for (d, _), (place, t) in zip(rows, order):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i:i + length]] < place:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def contaminated(rows, items, width=10):
    """(id, words, hit words, items, digest, flag) per row."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        names = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def spans(text, rules):
    """kind:start:end of matches by start and rule."""
    found = sorted((m.start(), i, kind, m.end()) for i, (kind, pattern, ok) in enumerate(rules)
                   for m in re.finditer(pattern, text or "", re.ASCII) if ok(m))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def only_digits(m):
    return re.sub("[^0-9]", "", m.group())


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only_digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m.group(2)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
]


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))
