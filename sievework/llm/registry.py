"""The corpus operators' queries, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import byte_pairs, common, decontaminate, imatch, language_id, licenses, line_dedup, packing, prefix_trie, ranked_search, sharding, simhash, surrogates, token_counts

#: Keys of surrogates and names of shards are settings of a deployment; these serve the queries.
SURROGATE_KEY = "sievework-query-key"
SHARD_NAMES = [f"shard-{i:03d}" for i in range(64)]
TOKEN_LIMIT = 512


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(common.documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(common.documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def learned(docs: DataFrame) -> tuple:
    """Prototypes from the documents that are not held out."""
    known = docs.select("text", "lang", "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return language_id.learn(known)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    made = language_id.predict(docs, *learned(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), with_ids=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir))
    sha = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(common.documents(spark, sf_dir).select("doc_id", "source"), "doc_id", SHARD_NAMES)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(common.documents(spark, sf_dir), SURROGATE_KEY)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(common.conversations(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    made = byte_pairs.decode(byte_pairs.encode(common.documents(spark, sf_dir), path, pattern), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, s, dw.k AS k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos, sha, chars
  FROM (
    SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS sha, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL)),
u AS (
  SELECT c, count(*) AS own, c - c % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM t GROUP BY c),
v AS (
  SELECT u.*, least(u.h, coalesce(b.own, 0)) AS taken, least(u.h, coalesce(b.own, 0)) + greatest(u.own - u.h, 0) AS n
  FROM u LEFT JOIN u AS b ON b.c = u.base),
r AS (
  SELECT v.c, t.pos AS depth, sha, chars FROM v JOIN t ON t.c = v.base WHERE t.pos <= v.taken
  UNION ALL SELECT v.c, v.taken + t.pos - v.h, sha, chars FROM v JOIN t ON t.c = v.c WHERE t.pos > v.h),
p AS (
  SELECT c, depth, string_agg(sha, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS path, chars FROM r
  UNION ALL SELECT c, 0, '', 0 FROM v),
k AS (SELECT depth, path, min(c) AS c, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY depth, path),
w AS (SELECT k.*, left(path, CAST(64 * (depth - 1) AS BIGINT)) AS up FROM k),
n AS (
  SELECT w.*, coalesce(ch.n_children, 0) AS n_children FROM w
  LEFT JOIN (SELECT depth - 1 AS depth, up, count(*) AS n_children FROM w WHERE depth > 0 GROUP BY ALL) ch ON ch.depth = w.depth AND ch.up = w.path),
g AS (
  SELECT d, left(path, CAST(64 * d AS BIGINT)) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY ALL),
e AS (SELECT p.depth, p.path, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN v ON v.c = p.c AND v.n = p.depth GROUP BY ALL)
SELECT n.c AS conv_id, CAST(n.depth AS BIGINT) AS depth, f.c AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, g.n_leaves,
  CAST(g.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN n AS f ON n.depth > 0 AND f.depth = n.depth - 1 AND f.path = n.up
JOIN g ON g.d = n.depth AND g.top = n.path
LEFT JOIN e ON e.depth = n.depth AND e.path = n.path
"""

OP12_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
d AS (SELECT d, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM dw WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (
  SELECT DISTINCT item, item_id, unnest(w) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
p AS (
  SELECT d, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT d, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
f AS (
  SELECT d, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // total))) AS part
  FROM p JOIN t ON p.term = t.term, s),
r AS (
  SELECT item, item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM f JOIN q ON f.term = q.term GROUP BY item, item_id, d, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""


def queries() -> dict:
    import corpus_pipeline

    own = (op1_imatch, op2_line_dedup, op3_language_id, op4_packing, op5_simhash, op6_license_scan, op7_token_counts, op8_decontamination, op9_sharding, op10_surrogates, op11_prefix_trie, op12_ranked_search, op13_byte_bpe)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op8_decontamination": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
