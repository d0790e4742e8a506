"""Operators 11 to 13 against brute force, SQL and odd rows."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import circulant_minhash, embedding_whitening, families, filter_audit, neighbour_quality
from tallyforge.llm.bytesets import mix
from tallyforge.llm.queries import QUERIES
from tests.conftest import FOLDER
from tests.llm import cases


def odd_documents(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA)


# -- 11: filter interaction audit ----------------------------------------------------------------

def audited(rows, good, toxic):
    """Every part, order and step by applying the filters one after the other."""
    rows = [(d, p or "", t or "") for d, t, p in rows]
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t] = min(least.get(t, d), d)

    def fails(name, d, t):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}[name]

    out, lost = [], {}
    for part in {p for _, p, _ in rows}:
        docs = [(d, {f for f in "ABCDE" if fails(f, d, t)}) for d, p, t in rows if p == part]
        steps = []
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                lost[part, f] = lost.get((part, f), 0) + len(gone)
                steps.append((part, "".join(order), step, len(alive), len(gone),
                              sum(f in x[1] for x in docs) - len(gone), sum(x[1] == {f} for x in docs),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(*s, lost[part, s[1][s[2] - 1]]) for s in steps]
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_documents(spark):
    rows = cases.documents() + [(21, "A# " * 300, None, "src9", None, None, None, None, None), (22, "A# " * 300, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("failed", F.lit("x")).withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (22, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.failed_sets(docs, labels), tuple("ABCDE"))
    assert out.columns == COLUMNS
    want = audited([(r[0], r[1], r[3]) for r in rows], {1, 2, 22}, {2, 22})
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert filter_audit.audit(filter_audit.failed_sets(docs.limit(0), labels.limit(0)), tuple("ABCDE")).count() == 0


def test_orders_through_edges():
    edges, place = filter_audit.lattice(5)
    assert len(edges) == 80
    assert all(w == math.factorial(s.bit_count()) * math.factorial(4 - s.bit_count()) for s, _, w in edges)
    assert len(filter_audit.paths(tuple("ABCDE"))) == 600
    with pytest.raises(ValueError):
        filter_audit.audit(None, tuple("ABCDEFG"))


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a b c", "p"), (2, "a b", "p"), (3, "a", "q")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"short": F.size("words") < 3, "b": F.col("text").contains("b")}
    rows = filter_audit.audit(filter_audit.failed_sets(docs, labels, filters), ("short", "b")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {
        ("p", "shortb", 1): (1, 1, 0, 1), ("p", "shortb", 2): (0, 1, 1, 3), ("p", "bshort", 1): (0, 2, 0, 3), ("p", "bshort", 2): (0, 0, 1, 1),
        ("q", "shortb", 1): (0, 1, 0, 2), ("q", "shortb", 2): (0, 0, 0, 0), ("q", "bshort", 1): (1, 0, 0, 0), ("q", "bshort", 2): (0, 1, 0, 2)}


# -- 12: circulant MinHash -----------------------------------------------------------------------

def near(rows, width=3, percent=85):
    return [(d, n, c, d == c) for d, n, c in cases.components(rows, width, percent)]


def test_coordinates_are_one_shifted_permutation():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 7, 9000, 20000, 3)]
    out = circulant_minhash.signatures(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    first = [mix(s + circulant_minhash._FIRST) for s in sets]
    for k in (0, 1, 77, circulant_minhash.COORDINATES - 1):
        for row, place in zip(out, first):
            shifted = (place + np.uint64(k)) * circulant_minhash._A
            assert row[k] == ((shifted ^ (shifted >> np.uint64(32))) * circulant_minhash._B).min()


def test_signatures_estimate_similarity():
    """Over many pairs of 85 % similarity, the share of equal coordinates is that, and no pair comes
    near the bound of the filter or misses all bands."""
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(300):
        both, a, b = np.split(rng.integers(0, 2**63, 200).astype(np.uint64), [170, 185])
        sets = [np.concatenate([both, a]), np.concatenate([both, b])]
        x, y = circulant_minhash.signatures(np.concatenate(sets), np.array([0, 185, 370]))
        shares.append((x == y).mean())
        keys = circulant_minhash.band_keys(np.stack([x, y]))
        assert (keys[0] == keys[1]).any()
        low = circulant_minhash.byte_signatures(np.stack([x, y]))
        assert (low[0] == low[1]).sum() >= circulant_minhash.alike_least(85) + 10
    assert abs(np.mean(shares) - 0.85) < 0.01


def test_near_components_of_odd_documents(spark):
    rows = cases.documents()
    out = circulant_minhash.near_components(odd_documents(spark))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert cases.ordered(out.collect()) == cases.ordered(near(cases.pairs(rows)))
    assert circulant_minhash.near_components(odd_documents(spark).limit(0)).count() == 0


def chain(rng, length, size=120, step=9):
    """Texts of which only neighbours are alike."""
    pool = [f"w{rng.integers(10**6)}" for _ in range(size + step * length)]
    return [" ".join(pool[i * step:i * step + size]) for i in range(length)]


def test_links_beside_the_pivot(spark, monkeypatch):
    """Chains and families whose members link with each other but not with the pivot, in small blocks."""
    monkeypatch.setattr(families, "BLOCK", 4)
    monkeypatch.setattr(families, "DIGESTS", 5)
    monkeypatch.setattr(families, "TOKENS", 700)
    rng = np.random.default_rng(8)
    texts = []
    for i in range(6):
        texts += chain(rng, 12, step=4 + i)
    base = [f"b{i}" for i in range(150)]
    for i in range(40):  # variants of one text in pairs: alike within a pair, at the border across pairs
        words = list(base)
        for at in rng.choice(150, 5 if i % 2 else 9, replace=False):
            words[at] = f"v{i // 2}" if i % 2 else f"u{i}"
        texts.append(" ".join(words))
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order] + [(1000 + int(i), texts[i]) for i in order[:30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cases.ordered(circulant_minhash.near_components(docs).collect()) == cases.ordered(near(rows))


def test_near_query(spark, tables):
    rows = [tuple(r) for r in tables.documents.select("doc_id", "text").collect()]
    assert cases.ordered(QUERIES["op12_minhash"](spark, FOLDER).collect()) == cases.ordered(near(rows))


# -- 13: whitening -------------------------------------------------------------------------------

def whitened(vectors, components=4, counts=False):
    """Per row: deviation and whitened entries; and shares of variance, in plain NumPy."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit, place, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    weight = copies if counts else np.ones(len(fit), int)
    n, sums = int(weight.sum()), (fit * weight[:, None]).sum(axis=0)
    centred = fit - sums / n
    v = (centred * weight[:, None]).T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(v)


def check_whitening(rows, out, counts=False):
    n, deviation, white, share = whitened([v for _, v in rows], counts=counts)
    got = {}
    for r in out.collect():
        assert r.n == n and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = (int(r.deviation), r.whitened, r.explained)
    assert len(got) == len(rows)
    signs = None
    for i, (vec_id, _) in enumerate(rows):
        assert sorted(got[vec_id]) == [1, 2, 3, 4]
        mine = np.array([got[vec_id][k][1] for k in (1, 2, 3, 4)])
        signs = np.sign(mine * white[i]) if signs is None else signs
        assert {got[vec_id][k][0] for k in (1, 2, 3, 4)} == {int(deviation[i])}
        np.testing.assert_allclose(mine, white[i] * signs, atol=1e-8)
        np.testing.assert_allclose([got[vec_id][k][2] for k in (1, 2, 3, 4)], share, rtol=1e-9)


def test_whitening_query(spark, tables):
    rows = [(r.vec_id, list(r.embedding)) for r in tables.embeddings.select("vec_id", "embedding").collect()]
    check_whitening(rows, QUERIES["op13_whitening"](spark, FOLDER))


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_of_odd_rows(spark, weights):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(50)]  # half of all rows are one vector
    rows.append((200, [-0.0] * 6))
    bad = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6),
           (304, [float("inf")] + [0.0] * 5), (305, [1.0] * 5), (306, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame([(k, v, 1, 2.0) for k, v in rows + bad], "vec_id long, embedding array<double>, n int, whitened double")
    check_whitening(rows, embedding_whitening.whiten(df, weights=weights), weights == "counts")
    empty = embedding_whitening.whiten(df.limit(0), weights=weights)
    assert empty.count() == 0 and empty.columns == embedding_whitening.whiten(df).columns
    assert embedding_whitening.whiten(df.filter("vec_id >= 302 and vec_id <= 304")).count() == 0


def test_whitening_without_variance(spark):
    rows = [(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(i, k) for i in (0, 1, 2) for k in (1, 2)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    out = embedding_whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in out)
    assert {round(r.explained, 12) for r in out} == {1.0, 0.0}


def test_whitening_beyond_a_long(spark):
    """Sums and deviations stay exact where long arithmetic would not."""
    big = 2.0 ** 38
    rows = [(i, [big * i, -big * (i % 3), float(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: int(r.deviation) for r in embedding_whitening.whiten(df).collect()}
    _, want, _, _ = whitened([v for _, v in rows], 3)
    assert [out[i] for i in range(40)] == [int(d) for d in want]


# -- 9: votes of equal neighbours ----------------------------------------------------------------

def test_votes_equal_a_plain_sort():
    """Ties at the border go to the earlier sample rows, as a stable sort would have it."""
    rng = np.random.default_rng(1)
    cosines = rng.integers(0, 6, (200, 80)).astype(np.float32) / 5
    cosines[:20] = 1.0
    near = neighbour_quality.nearest_columns(cosines, 15)
    want = np.argsort(-cosines, axis=1, kind="stable")[:, :15]
    assert (np.sort(near, axis=1) == np.sort(want, axis=1)).all()
