"""One query per operator over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import contamination, hardneg, importance, linededup, mixing, neardup, packing, quality, sharding, substrings, tokencount, urlfilter, warc

#: Fixed values of the contract for URL rules: (host, path, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

SPACED_SQL = r"'[^\x20\x09-\x0D]+'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(table(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS head FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to FROM h
"""


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# Texts as hexadecimal digits, two a byte; windows by the digest of their 800 digits.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 399)) AS i FROM d WHERE length(x) >= 800)),
r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last FROM s GROUP BY doc_id),
c AS (SELECT s.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM s) AS s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {SPACED_SQL}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT id, min(seen) AS root FROM r GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM documents JOIN k ON k.id = doc_id LEFT JOIN n USING (doc_id)
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end_word"] - x["first_word"])
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED_SQL}) AS w FROM documents),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, {SPACED_SQL}) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT c.*, {quality.BASE} AS base_failed, NOT ({quality.BASE} OR {" OR ".join(f"({r.sql})" for r in quality.RULES)}) AS kept
FROM c JOIN (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {SPACED_SQL})) AS lines FROM d) USING (doc_id)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """The vocabulary file's path is a parameter; by default the public 32,000 piece model's."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = str(public_tokenizers.path("piece_bpe_32k.model"))
    out = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.load_vocabulary(vocabulary_path), keep=["doc_id"], keep_blanks=tokencount.keeps_blanks(vocabulary_path))
    return out.select("row.doc_id", "n_words", "n_tokens", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a line goes; passages that repeat, which begin and end inside lines, are further columns."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), passage_words=OP7_PASSAGE)
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    size = lambda c: F.size(c).cast("long")
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return out.select(F.col("id").alias("doc_id"), "n_units", size("removed").alias("n_removed"), spans("removed").alias("removed_spans"), kept.alias("kept_sha256"), size("passages").alias("n_passages"), spans("passages").alias("passage_spans"))


#: A passage of over 50 words is cut by its ends inside sentences; half of it is asked to be whole ones.
OP7_PASSAGE = 25


def _again(unit: str) -> str:
    """Units of all texts with their end (`upto`), words (`n`) and whether an equal one stands before."""
    words = f"regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {SPACED_SQL})"
    cut = f"SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{linededup.UNITS[unit]}') AS u FROM documents)"
    placed = f"SELECT *, CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto, {words} AS w FROM ({cut})"
    return f"SELECT doc_id, unit, k, upto, len(w) AS n, len(w) > 0 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, k) > 1 AS again FROM ({placed})"


OP7_SQL = rf"""
WITH l AS ({_again("line")}),
k AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (again) AS n_removed, string_agg((upto - length(unit)) || '-' || upto, ',' ORDER BY k) FILTER (again) AS spans, string_agg(unit, '' ORDER BY k) FILTER (NOT again) AS kept FROM l GROUP BY doc_id),
s AS (SELECT *, sum(CASE WHEN n > 0 AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM ({_again("sentence")})),
r AS (SELECT doc_id, min(upto - length(unit)) AS a, max(upto) AS b FROM s WHERE again GROUP BY doc_id, run HAVING sum(n) >= {OP7_PASSAGE}),
p AS (SELECT doc_id, count(*) AS n_passages, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(k.spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_passages, 0) AS n_passages, coalesce(p.spans, '') AS passage_spans
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN p USING (doc_id)
"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {SPACED_SQL})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_value(5, 2, 1)[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s),
f AS (SELECT r.*, (1.5 * (SELECT sum(source_size) FROM r) - 2.0 * coalesce((SELECT sum(source_size) FROM r AS x WHERE x.k < r.k), 0)) / (SELECT sum(w) FROM r AS x WHERE x.k >= r.k) AS lam FROM r),
o AS (SELECT *, lam * w >= 2.0 * source_size AS over FROM f),
t AS (SELECT source, source_size, round(CASE WHEN over THEN 2.0 * source_size ELSE (SELECT arg_min(lam, k) FROM o WHERE NOT over) * w END, 6) AS target FROM o),
k AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1 AS k,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(md5(coalesce(d.source, '') || '|7'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor((k + 1) * rate + u) - floor(k * rate + u)) * size AS BIGINT) AS taken FROM k
"""


def op9_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return out.select("row.page_id", "host", "path", "rule", "verdict")


_FITS = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in URL_RULES]
_BEST = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in sorted(zip(_FITS, URL_RULES, strict=True), key=lambda x: -len(x[1][0] + x[1][1])))
OP10_SQL = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_BEST} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)} ELSE 'allow' END AS verdict FROM r
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hardneg.hard_negatives(moved).drop("positive_rank")


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


# The table of a byte's CRC follows from the polynomial, a word's CRC from its bytes.
OP12_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d), mw AS (SELECT unnest(w) AS w FROM m),
x AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM mw)),
b AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, CAST(length(h) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS b FROM x, k),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM mw JOIN b USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM mw) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
v AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (doc_id)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM f WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CAST(k AS BIGINT) AS rank FROM f LEFT JOIN (SELECT * FROM r WHERE k <= (SELECT count(*) FROM r) * 10 // 100) AS r ON r.doc_id = f.doc_id
"""


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The tokenizer file's path is a parameter; by default the public byte-level one's."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path, keep=["doc_id"], with_ids=False)
    return out.select("row.doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    pairs = {"op1_warc": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op7_substring_dedup": OP7_SQL}
    pairs |= {"op4_benchmark_decontamination": OP4_SQL, "op5_quality_rules": OP5_SQL, "op8_source_mixing": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance_resampling": OP12_SQL}
    return pairs
