"""The operators of this folder bound to the test tables, each over its whole table, and the SQL
that states the expected rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import blob_ledger, chat_template, circulant_minhash, combination_prefix, content_sort, disclosure, \
    embedding_whitening, filter_audit, language_bits, neighbour_quality, suffix_dedup, window_packing, wu_manber
from tallyforge.llm.common import held_out, table
from tallyforge.llm.spans import count_of, span_text


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_bits.learn_languages(docs.filter(~held_out("doc_id")))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return language_bits.identify_languages(rows, model).drop("text")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    return window_packing.pack(table(spark, folder, "documents"), tokenizer_path()).drop("ids")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return wu_manber.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return combination_prefix.jaccard_components(table(spark, folder, "documents"))


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = blob_ledger.findings_by_path(docs, blob_ledger.update_ledger(docs), path_col="doc_id")
    counts = [count_of(F.col("findings"), r.kind).alias(f"n_{r.kind}") for r in blob_ledger.RULES]
    spans = span_text(F.col("findings"))
    return found.select(
        F.col("path").alias("doc_id"), *counts,
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


#: The text with control strings that the contract adds as conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat_template.chat_digest(chat_template.format_conversations(rows.unionByName(extra)))


def op8_personal(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.personal_data(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in disclosure.KINDS],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


QUALITY_THRESHOLD = 0.7


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = neighbour_quality.learn_quality(docs, table(spark, folder, "labels").filter(~held_out("doc_id")))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return neighbour_quality.score_quality(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.exact_dedup(table(spark, folder, "documents"))


def op11_audit(spark: SparkSession, folder: str) -> DataFrame:
    counts = filter_audit.failed_sets(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(counts, tuple("ABCDE"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return circulant_minhash.near_components(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = embedding_whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_pack, op3_decontaminate, op4_jaccard, op5_repeats, op6_secrets, op7_chat, op8_personal, op9_quality, op10_exact,
    op11_audit, op12_minhash, op13_whitening)}

SQL10 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text"""

# a list of (start, rank, kind, stop) of one kind, from the pieces between the matches
_SPANS = """list_transform(list_zip(pieces_{k}, whole_{k}, judged_{k}, range(1, len(whole_{k}) + 1)),
      lambda z: {{'start': list_sum(list_transform(pieces_{k}[1:z[4]], lambda p: length(p)))
                   + coalesce(list_sum(list_transform(whole_{k}[1:z[4] - 1], lambda p: length(p))), 0),
                 'rank': {rank}, 'kind': '{k}', 'long': length(z[2]), 'judged': length(z[3])}})"""


def _ledger_sql() -> str:
    def literal(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    columns = ", ".join(
        f"regexp_extract_all(text, {literal(r.pattern)}, 0) AS whole_{r.kind}, "
        f"regexp_extract_all(text, {literal(r.pattern)}, {r.group}) AS judged_{r.kind}, "
        f"regexp_split_to_array(text, {literal(r.pattern)}) AS pieces_{r.kind}" for r in blob_ledger.RULES)
    lists = ", ".join(f"list_filter({_SPANS.format(k=r.kind, rank=r.rank)}, "
                      f"lambda s: s['judged'] >= {r.least}) AS found_{r.kind}" for r in blob_ledger.RULES)
    joined = " || ".join(f"found_{r.kind}" for r in blob_ledger.RULES)
    counts = ", ".join(f"len(found_{r.kind}) AS n_{r.kind}" for r in blob_ledger.RULES)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, {columns} FROM t),
l AS (SELECT doc_id, {lists} FROM m),
s AS (SELECT doc_id, {counts}, array_to_string(list_transform(list_sort({joined}),
  lambda s: concat_ws(':', s['kind'], cast(s['start'] as bigint), cast(s['start'] + s['long'] as bigint))), ',') AS spans FROM l)
SELECT doc_id, {', '.join('n_' + r.kind for r in blob_ledger.RULES)}, sha256(spans) AS base_sha256, spans FROM s"""


def _disclosure_sql(limits: disclosure.Thresholds = disclosure.Thresholds()) -> str:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    digits = "regexp_replace(s['value'], '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN cast(substr(reverse({digits}), i + 1, 1) AS int) "
            f"ELSE (cast(substr(reverse({digits}), i + 1, 1) AS int) * 2) // 10 + (cast(substr(reverse({digits}), i + 1, 1) AS int) * 2) % 10 END)) % 10 = 0")
    rules = {  # kind: pattern, what a match must fulfil
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(s['value'], '{octet}(?:\.{octet}){{3}}')"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
    }
    matches = ", ".join(f"regexp_extract_all(text, '{p}') AS whole_{k}, regexp_split_to_array(text, '{p}') AS pieces_{k}"
                        for k, (p, _) in rules.items())
    found = ", ".join(f"""list_filter(list_transform(list_zip(pieces_{k}, whole_{k}, range(1, len(whole_{k}) + 1)), lambda z: {{
      'start': cast(list_sum(list_transform(pieces_{k}[1:z[3]], lambda p: length(p)))
        + coalesce(list_sum(list_transform(whole_{k}[1:z[3] - 1], lambda p: length(p))), 0) AS bigint),
      'rank': {i}, 'kind': '{k}', 'long': length(z[2]), 'value': z[2]}}), lambda s: s['value'] IS NOT NULL AND ({ok})) AS found_{k}"""
                      for i, (k, (_, ok)) in enumerate(rules.items()))
    joined = " || ".join(f"found_{k}" for k in rules)
    counts = ", ".join(f"len(found_{k}) AS n_{k}" for k in rules)
    words = r"list_distinct(list_filter(regexp_split_to_array({0}, '[^\pL\pN]+'), lambda w: length(w) > 2))"
    text_of = "array_to_string(list_transform({0}, lambda s: concat_ws(':', s['kind'], s['start'], s['start'] + s['long'])), ',')"
    around = f"""substr(text, greatest(s['start'] - {disclosure.CONTEXT_CHARS}, 0) + 1, s['start'] - greatest(s['start'] - {disclosure.CONTEXT_CHARS}, 0))
      || ' ' || substr(text, s['start'] + s['long'] + 1, {disclosure.CONTEXT_CHARS})"""
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, {matches} FROM t),
l AS (SELECT doc_id, text, {found} FROM m),
b AS (SELECT doc_id, text, {counts}, list_sort({joined}) AS base FROM l),
contexts AS (SELECT DISTINCT s['kind'] AS kind, CASE s['kind'] WHEN 'email' THEN lower(s['value']) ELSE {digits} END AS value, {around} AS around
  FROM (SELECT text, unnest(base) AS s FROM b)),
together AS (SELECT kind, value, term, count(*) AS together FROM (
  SELECT kind, value, unnest({words.format('around')}) AS term FROM contexts) GROUP BY ALL HAVING count(*) >= {limits.support}),
entity AS (SELECT kind, value, count(*) AS contexts FROM contexts GROUP BY ALL),
spread AS (SELECT term, count(*) AS docs FROM (SELECT unnest({words.format('text')}) AS term FROM (SELECT DISTINCT text FROM t)) GROUP BY term),
terms AS (SELECT DISTINCT term FROM together JOIN entity USING (kind, value) JOIN spread USING (term)
  WHERE log2(together * (SELECT count(DISTINCT text) FROM t)::double / (docs * contexts)) >= {limits.bits} AND together / docs::double >= {limits.share}),
w AS (SELECT doc_id, regexp_extract_all(text, '[\\pL\\pN]+') AS words, regexp_split_to_array(text, '[\\pL\\pN]+') AS gaps FROM t),
p AS (SELECT doc_id, words, gaps, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS term FROM w),
a AS (SELECT doc_id, list({{'start': cast(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(words[1:i - 1], lambda g: length(g))), 0) AS bigint),
  'rank': {len(rules)}, 'kind': '{disclosure.TERM}', 'long': length(term), 'value': term}}) AS added
  FROM p SEMI JOIN terms ON p.term = terms.term GROUP BY doc_id)
SELECT b.doc_id, {', '.join('n_' + k for k in rules)}, sha256({text_of.format('base')}) AS base_sha256,
  {text_of.format('list_sort(base || coalesce(added, []))')} AS spans FROM b LEFT JOIN a ON a.doc_id = b.doc_id"""


def _words(source: str) -> str:
    return (f"regexp_extract_all(translate({source}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


SQL3 = f"""WITH item AS (SELECT cast(item_id AS varchar) AS item, {_words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS window FROM (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
doc AS (SELECT doc_id, coalesce({_words('text')}, []) AS w FROM documents),
places AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS window FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, p.n, i FROM places p JOIN win ON p.n = win.n AND p.window = win.window),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS names
  FROM hit GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

SQL7 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
o AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS listing,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, ''
             ORDER BY turn, role, text) AS machine,
  sum(length(CASE role WHEN 'system' THEN '[SYS][/SYS]' WHEN 'user' THEN '[INST][/INST]' WHEN 'assistant' THEN '[OUT]</s>'
      ELSE concat('[ROLE][/ROLE][/TURN]', role) END)
    + length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
             '\\[(/?SYS|/?INST|OUT|/?ROLE|/TURN)\\]|</s>', '\\0?', 'g'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listing) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  cast(formatted_chars AS bigint) AS formatted_chars, regexp_full_match(machine, 's?(ua)+') AS valid FROM o"""

SQL11 = """WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  min(doc_id) OVER (PARTITION BY text) AS least FROM t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS failed
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, cast(step AS int) AS step, bits[step] AS bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) AS int) AS before
  FROM o, unnest(range(1, 6)) AS r(step)),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed,
  cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost,
  cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM r"""

ORACLES = {"op11_audit": SQL11, "op3_decontaminate": SQL3, "op6_secrets": _ledger_sql(), "op7_chat": SQL7, "op8_personal": _disclosure_sql(), "op10_exact": SQL10}
