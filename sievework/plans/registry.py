"""Queries over the driver's tables, one per operator, each with its SQL twin where SQL can say it.

The tables stand for a curated dataset: orders for samples and lineitem for their annotations,
events for JSON metadata, documents.source for tags, labels for predictions and truth,
conversations for videos with frames, region > nation > customer for a collection tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import metadata as M
from sievework.functions import predicates as P
from sievework.functions import vectors as V
from sievework.operators import catalog, embeddings, evaluate, facets, groups, ordering, selection
from sievework.sources import writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _large_line(d, s, test):
    return P.exists_child(read(s, d, "lineitem"), "l_orderkey", "o_orderkey", test)


# Predicates ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def match_exists_or_field(s, d):
    return read(s, d, "orders").where((F.col("o_totalprice") > 400000) | _large_line(d, s, F.col("l_quantity") > 49)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def match_not_exists(s, d):
    return read(s, d, "orders").where(~_large_line(d, s, F.col("l_quantity") > 25)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_discount >= 0.05 AND l_returnflag = 'R')")
def match_same_child_all_criteria(s, d):
    test = P.all_of(F.col("l_quantity") > 40, F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R")
    return read(s, d, "orders").where(_large_line(d, s, test)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def match_two_children(s, d):
    return read(s, d, "orders").where(_large_line(d, s, F.col("l_quantity") > 45) & _large_line(d, s, F.col("l_returnflag") == "R")).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1)")
def match_nullable_3vl(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels"), "doc_id", "left").where(~(F.col("quality") == 1)).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 1, false)")
def parent_field_has(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels"), "doc_id", "left").where(~P.related(F.col("quality") == 1)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND n_chars BETWEEN 500 AND 2000")
def tags_any_of_in_range(s, d):
    return read(s, d, "documents").where(F.col("source").isin("src1", "src3") & P.in_range(F.col("n_chars"), 500, 2000)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR (lang = 'de' AND NOT n_chars > 1000)) AND NOT source = 'src0'")
def boolean_tree(s, d):
    test = P.all_of(P.any_of(F.col("lang") == "en", P.all_of(F.col("lang") == "de", ~(F.col("n_chars") > 1000))), ~(F.col("source") == "src0"))
    return read(s, d, "documents").where(test).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00' AND o_orderstatus != 'O'")
def datetime_compare(s, d):
    return read(s, d, "orders").where((F.col("o_orderdate") > F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "O")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def in_id_set(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def id_set_intersect(s, d):
    labels = read(s, d, "labels")
    some = labels.where("toxic = 1").select("doc_id").intersect(labels.where("quality = 1").select("doc_id"))
    return some.intersect(read(s, d, "documents").where("lang = 'en'").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_set_minus(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def parent_exists(s, d):
    good = read(s, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return read(s, d, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT vec_id FROM embeddings WHERE false")
def empty_region(s, d):
    return read(s, d, "embeddings").where(P.any_of()).select("vec_id")


@query("SELECT p_partkey, l.n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey WHERE p_size > 40")
def join_then_aggregate(s, d):
    n = read(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return read(s, d, "part").where("p_size > 40").join(n, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "n")


# Metadata --------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def metadata_compare_number(s, d):
    return read(s, d, "events").where(M.compare(F.col("props"), "k", ">=", 50)).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '7') OR json_extract_string(props, '$.k') IS NULL")
def metadata_in_or_missing(s, d):
    return read(s, d, "events").where(M.is_in(F.col("props"), "k", ["1", "7", None])).select("event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY try_cast(json_extract_string(props, '$.k') AS DOUBLE) NULLS LAST, json_extract_string(props, '$.k') NULLS LAST, event_id) AS place FROM events ORDER BY place LIMIT 100")
def metadata_order(s, d):
    page = read(s, d, "events").orderBy(*M.sort_keys(F.col("props"), "k"), "event_id").limit(100)
    listed = page.agg(F.collect_list(F.struct(M.at_path(F.col("props"), "k").try_cast("double").alias("n"), "event_id")).alias("e"))
    return listed.select(F.posexplode(F.array_sort("e")).alias("place", "e")).select("e.event_id", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT 'k' AS key, count(json_extract_string(props, '$.k')) AS n, min(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS low, max(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS high FROM events")
def metadata_info(s, d):
    return M.key_info(read(s, d, "events"), "props")


# Facets ----------------------------------------------------------------------------------------

_KEPT = "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"


def _kept(s, d):
    return read(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))


@query(f"SELECT l_returnflag, count(*) FILTER (WHERE l_orderkey IN ({_KEPT})) AS current, count(*) AS total FROM lineitem GROUP BY l_returnflag")
def class_counts_objects(s, d):
    return facets.class_counts(read(s, d, "lineitem"), "l_returnflag", "l_orderkey", _kept(s, d))


@query(f"SELECT l_returnflag, count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IN ({_KEPT})) AS current, count(DISTINCT l_orderkey) AS total FROM lineitem GROUP BY l_returnflag")
def class_counts_samples(s, d):
    return facets.class_counts(read(s, d, "lineitem"), "l_returnflag", "l_orderkey", _kept(s, d), distinct_parents=True)


@query("SELECT f.l_returnflag, t.l_linestatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) t LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.l_returnflag = f.l_returnflag AND c.l_linestatus = t.l_linestatus")
def class_counts_by_tag(s, d):
    return facets.tag_grid(read(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT label, count(DISTINCT k) AS n FROM (SELECT l_returnflag AS label, l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderstatus, o_orderkey FROM orders) GROUP BY label")
def facet_union_distinct(s, d):
    a = read(s, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("k"))
    return facets.union_distinct_counts("label", "k", a, read(s, d, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("k")))


def _histogram_sql(kept: str) -> str:
    return f"""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT CAST(least(greatest(floor((o_totalprice - lo) / ((hi - lo) / 20)), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, b WHERE {kept} GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN c ON c.bin = r.bin"""


@query(_histogram_sql("true"))
def histogram_fixed_width(s, d):
    return facets.histogram(read(s, d, "orders"), F.col("o_totalprice")).select("bin", "n")


@query(_histogram_sql("o_orderstatus = 'F'"))
def histogram_filtered(s, d):
    return facets.histogram(read(s, d, "orders"), F.col("o_totalprice"), kept=F.col("o_orderstatus") == "F").select("bin", "n")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 20")
def top_categorical(s, d):
    return facets.top_values(read(s, d, "documents"), F.col("source"))


@query("SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders")
def value_bounds(s, d):
    return facets.bounds(read(s, d, "orders"), "o_totalprice", "o_custkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def having_all_labels(s, d):
    return facets.having_all_labels(read(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("SELECT doc_id, CAST(slot AS INTEGER) AS slot FROM documents JOIN (SELECT source, 2 + row_number() OVER (ORDER BY count(*) DESC, source) AS slot FROM documents GROUP BY source) USING (source)")
def color_frequency_slots(s, d):
    return facets.frequency_slots(read(s, d, "documents"), F.col("source"), "doc_id").select("doc_id", F.col("slot").cast("int").alias("slot"))


@query("SELECT p_partkey, CAST(floor(p_size / 5) AS BIGINT) AS bucket FROM part")
def color_integer_buckets(s, d):
    return read(s, d, "part").select("p_partkey", F.floor(F.col("p_size") / 5).alias("bucket"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def group_sample_counts(s, d):
    n = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY l_suppkey")
def kinds_per_source(s, d):
    return read(s, d, "lineitem").groupBy("l_suppkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("kinds"))


# Orders and pages --------------------------------------------------------------------------------


@query("SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id DESC) AS place FROM documents LEFT JOIN labels USING (doc_id) QUALIFY place <= 50")
def order_nulls_last_multi(s, d):
    rows = read(s, d, "documents").select("doc_id", "n_chars").join(read(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    page = ordering.page(rows, [("quality", True), ("n_chars", True)], "doc_id", 0, 50)
    key = F.struct((-F.coalesce("quality", F.lit(-1))).alias("a"), (-F.col("n_chars")).alias("b"), (-F.col("doc_id")).alias("c"), "doc_id", "quality")
    return page.agg(F.array_sort(F.collect_list(key)).alias("e")).select(F.posexplode("e").alias("at", "e")).select("e.doc_id", "e.quality", (F.col("at") + 1).cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 20")
def page_slice(s, d):
    return ordering.page(read(s, d, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", False)], "o_orderkey", 20, 60).select("o_orderkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice, o_orderkey LIMIT 10")
def page_with_total(s, d):
    rows = read(s, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return ordering.page_with_total(rows, [("o_totalprice", False)], "o_orderkey", 0, 10).select("o_orderkey", "total")


@query("SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following, row_number() OVER w AS position FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)")
def adjacency_window(s, d):
    rows = read(s, d, "documents").select("source", "n_chars", "doc_id")
    return ordering.neighbours_within(rows, "source", ["n_chars", "doc_id"], "doc_id").withColumn("position", F.col("position").cast("long"))


@query("SELECT previous, following, position, total FROM (SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following, row_number() OVER w AS position, count(*) OVER () AS total FROM documents WINDOW w AS (ORDER BY n_chars, doc_id)) WHERE doc_id = 100")
def adjacency_keyset(s, d):
    rows = read(s, d, "documents").select("n_chars", "doc_id")
    anchor = rows.where("doc_id = 100").first().asDict()
    return ordering.neighbours(rows, ["n_chars", "doc_id"], anchor)


@query("SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def first_child_per_parent(s, d):
    return ordering.first_child(read(s, d, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(floor((rn - 1) / 2) AS INTEGER) AS chunk FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn <= n - n % 2")
def sequence_chunks(s, d):
    return ordering.chunks(read(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)


@query("SELECT event_id FROM events WHERE event_id = 0 OR floor(event_id * 10.0 / 25.0) != floor((event_id - 1) * 10.0 / 25.0)")
def frame_keep_rule(s, d):
    return read(s, d, "events").where(ordering.keeps_frame(F.col("event_id"), 25.0, 10.0)).select("event_id")


# Vectors ---------------------------------------------------------------------------------------

_COS = "list_sum([CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE) for i in range(1, len(a) + 1)]) / (sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in a])) * sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in b])))"


def _vectors(s, d):
    return read(s, d, "embeddings")


@query(f"WITH p AS (SELECT query_id, vec_id, {_COS} AS c FROM (SELECT e.vec_id, q.vec_id AS query_id, e.embedding AS a, q.embedding AS b FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) SELECT query_id, vec_id, round(c, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) <= 10")
def cosine_topk(s, d):
    queries = _vectors(s, d).where("vec_id % 100 = 0")
    return embeddings.search(_vectors(s, d), queries, 10).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))


_DIST = "sqrt(list_sum([(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)) ** 2 for i in range(1, len(a) + 1)]))"


@query(f"WITH p AS (SELECT e.vec_id, min({_DIST}) AS dist FROM (SELECT e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) e GROUP BY e.vec_id) SELECT vec_id, round(exp(-dist / (SELECT avg(dist) FROM p)), 4) AS similarity FROM p")
def nn_similarity(s, d):
    return embeddings.similarity_to(_vectors(s, d), _vectors(s, d).where("vec_id % 100 = 0")).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH p AS (SELECT x.vec_id, {_DIST} AS dist FROM (SELECT e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e JOIN embeddings q ON e.vec_id != q.vec_id) x), k AS (SELECT vec_id, dist FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist) <= 20) SELECT vec_id, round(avg(exp(-dist / (SELECT avg(dist) FROM k))), 4) AS typicality FROM k GROUP BY vec_id")
def typicality_knn(s, d):
    return embeddings.typicality(_vectors(s, d)).select("vec_id", F.round("typicality", 4).alias("typicality"))


@query("SELECT vec_id FROM embeddings WHERE embedding[1] >= -0.1 AND embedding[1] < 0.1 AND embedding[2] >= -0.05 AND embedding[2] < 0.2")
def lasso_points(s, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return _vectors(s, d).where(V.inside_polygon(x, y, [(-0.1, -0.05), (0.1, -0.05), (0.1, 0.2), (-0.1, 0.2)])).select("vec_id")


@query()
def projection_2d(s, d):
    return embeddings.project(_vectors(s, d))


# Selection -------------------------------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice / (SELECT max(abs(p_retailprice)) FROM part) - 0.5 * p_size / (SELECT max(abs(p_size)) FROM part), 9) AS score FROM part ORDER BY p_retailprice / (SELECT max(abs(p_retailprice)) FROM part) - 0.5 * p_size / (SELECT max(abs(p_size)) FROM part) DESC, p_partkey LIMIT 25")
def select_weighted(s, d):
    return selection.weighted(read(s, d, "part"), 25, [("p_retailprice", 1.0), ("p_size", -0.5)], "p_partkey").select("p_partkey", F.round("score", 9).alias("score"))


@query()
def select_diverse(s, d):
    return selection.diverse(_vectors(s, d), 10, "vec_id", "embedding")


@query()
def select_dedup(s, d):
    return selection.diverse(_vectors(s, d), 10, "vec_id", "embedding", least=0.5)


@query()
def select_balanced(s, d):
    rows = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("labels"))
    return selection.balanced(rows, 6, "l_orderkey", {"A": 0.4, "N": 0.2, "R": 0.4})


# Evaluation ------------------------------------------------------------------------------------


def _labels(s, d):
    return read(s, d, "labels")


@query("SELECT doc_id AS sample, CAST(CASE WHEN quality = toxic THEN 1 - 0.75 ELSE 0.75 END AS DOUBLE) AS disagreement FROM labels")
def eval_classification(s, d):
    gt = _labels(s, d).select(F.col("doc_id").alias("sample"), F.col("quality").alias("label"))
    pred = _labels(s, d).select(F.col("doc_id").alias("sample"), F.col("toxic").alias("label"), F.lit(0.75).alias("confidence"))
    return evaluate.disagreement(gt, pred)


@query("""WITH p AS (SELECT coalesce(CASE WHEN quality = 1 THEN 'q1' WHEN doc_id % 3 = 0 THEN NULL ELSE 'q0' END, '(no ground truth)') AS g, coalesce(CASE WHEN toxic = 1 THEN 'q1' ELSE 'q0' END, '(no prediction)') AS p FROM labels),
l AS (SELECT 'q0' AS l UNION SELECT 'q1')
SELECT a.g AS gt_label, b.p AS pred_label, count(p.g) AS n FROM (SELECT l AS g FROM l UNION SELECT '(no ground truth)') a CROSS JOIN (SELECT l AS p FROM l UNION SELECT '(no prediction)') b LEFT JOIN p ON p.g = a.g AND p.p = b.p GROUP BY 1, 2""")
def eval_confusion_matrix(s, d):
    gt = F.when(F.col("quality") == 1, "q1").when(F.col("doc_id") % 3 != 0, "q0")
    return evaluate.confusion(_labels(s, d).select(gt.alias("gt_label"), F.when(F.col("toxic") == 1, "q1").otherwise("q0").alias("pred_label")))


@query("SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def eval_confusion_predicate(s, d):
    return _labels(s, d).where(F.col("quality").eqNullSafe(1) & F.col("toxic").eqNullSafe(0)).select("doc_id").distinct()


def _boxes(s, d, shift):
    x = (F.col("l_partkey") % 50 + shift).cast("int")
    rows = read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"),
        x.alias("x"), (F.col("l_suppkey") % 10).cast("int").alias("y"), (F.col("l_quantity") + 1).cast("int").alias("width"), F.lit(20).alias("height"), F.col("l_discount").alias("confidence"),
    )
    return rows


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS x, l_suppkey % 10 AS y, l_quantity + 1 AS w FROM lineitem),
i AS (SELECT id, w, greatest(0, least(x + w, x + 5 + w) - greatest(x, x + 5)) * 20 AS shared FROM b) SELECT id, round(shared / (2 * w * 20 - shared), 9) AS iou FROM i""")
def eval_box_iou(s, d):
    box = lambda x: F.struct(x.alias("x"), "y", "width", "height")
    return _boxes(s, d, 0).select("id", F.round(V.box_iou(box(F.col("x")), box(F.col("x") + 5)), 9).alias("iou"))


def _matched(s, d):
    # Order and line do not name a row of this table, so a hash of all its columns does.
    own = lambda rows: rows.withColumn("id", F.xxhash64("id", "x", "y", "width", "confidence"))
    return evaluate.match_boxes(own(_boxes(s, d, 0)).drop("confidence"), own(_boxes(s, d, 4)), 0.5)


@query()
def eval_greedy_match(s, d):
    return _matched(s, d)


@query()
def eval_sample_counts(s, d):
    return evaluate.sample_counts(_matched(s, d))


# Tables, tags, copies, exports --------------------------------------------------------------------


@query("SELECT doc_id, 'src1' AS tag FROM documents WHERE source = 'src1' UNION SELECT doc_id, 'long' FROM documents WHERE n_chars > 3000")
def tag_from_query(s, d):
    docs = read(s, d, "documents")
    links = docs.where("source = 'src1'").select("doc_id", F.lit("src1").alias("tag"))
    return catalog.add_links(links, docs.where("n_chars > 3000").select("doc_id", F.lit("long").alias("tag")))


@query("SELECT doc_id, source AS tag FROM documents WHERE n_chars <= 3000")
def untag(s, d):
    docs = read(s, d, "documents")
    return catalog.remove_links(docs.select("doc_id", F.col("source").alias("tag")), docs.where("n_chars > 3000").select("doc_id", F.col("source").alias("tag")))


@query("SELECT sha256('copy:' || n_nationkey) AS n_nationkey, n_name, sha256('copy:' || n_regionkey) AS n_regionkey FROM nation")
def deep_copy_remap(s, d):
    nation, region = read(s, d, "nation"), read(s, d, "region")
    made = nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    ids = lambda t, k: catalog.new_ids(t.select(F.col(k).cast("string").alias(k)), k, "copy")
    return catalog.remap(catalog.remap(made, ids(nation, "n_nationkey"), "n_nationkey"), ids(region, "r_regionkey"), "n_regionkey")


@query("SELECT l_returnflag, l_linenumber, l_orderkey, CASE WHEN l_quantity > 45 THEN 'big' ELSE l_linestatus END AS l_linestatus FROM lineitem WHERE l_returnflag <> 'A'")
def relabel_and_delete(s, d):
    rows = catalog.rewrite(read(s, d, "lineitem"), F.col("l_quantity") > 45, l_linestatus="big")
    return catalog.delete_labels(rows, "l_returnflag", ["A"]).select("l_returnflag", "l_linenumber", "l_orderkey", "l_linestatus")


@query("SELECT 'r' || r_regionkey AS key, 'r' || r_regionkey AS root, 0 AS level, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def collection_hierarchy(s, d):
    a = read(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    b = read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return catalog.hierarchy(a.unionByName(b), "key", "parent", "name")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS image_id, dense_rank() OVER (ORDER BY source) AS category_id FROM documents")
def export_dense_ids(s, d):
    docs = read(s, d, "documents").select("doc_id", "source")
    numbered = writers.number_rows(docs, ["source", "doc_id"], "image_id")
    return numbered.join(writers.dense_ids(docs, "source", 1), "source").select("doc_id", "image_id", F.col("id").cast("long").alias("category_id"))


@query("SELECT 'doc-' || doc_id AS file_path_abs, CAST(quality AS VARCHAR) AS class_name, CAST(0.5 AS DOUBLE) AS confidence, 'human' AS annotation_source FROM labels JOIN documents USING (doc_id)")
def export_csv_rows(s, d):
    images = read(s, d, "documents").select(F.col("doc_id").alias("sample"), F.concat(F.lit("doc-"), "doc_id").alias("file_path_abs"))
    notes = _labels(s, d).select(F.col("doc_id").alias("sample"), F.col("quality").cast("string").alias("label"), F.lit(0.5).alias("confidence"), F.lit("human").alias("annotation_source"))
    return writers.classification_rows(notes, images)


@query("SELECT d.doc_id, coalesce(n, 0) AS n_turns FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id")
def view_with_children(s, d):
    turns = read(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = read(s, d, "documents").select("doc_id").join(turns, F.col("doc_id") == F.col("conv_id"), "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_turns"))


# Groups, metric orders, sequence proxies -----------------------------------------------------------


@query("SELECT o_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS \"1\", max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS \"2\", max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS \"3\" FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def group_components(s, d):
    return groups.components(read(s, d, "orders").select("o_orderkey"), read(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey"), [1, 2, 3], "o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, min({'a': l_linenumber, 'b': l_partkey}).b AS preview FROM lineitem GROUP BY l_orderkey")
def group_previews(s, d):
    return groups.previews(read(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, l_linenumber IN (1, 2, 3, 4, 5) AS known FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_linenumber NOT IN (1, 2, 3, 4, 5)")
def group_violations(s, d):
    return groups.violations(read(s, d, "lineitem"), [1, 2, 3, 4, 5], "l_orderkey", "l_linenumber")


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS metric_value FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id DESC LIMIT 50")
def order_by_metric(s, d):
    metrics = read(s, d, "labels").select(F.col("doc_id").alias("sample"), F.lit("r1").alias("run"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value"))
    return ordering.by_metric(read(s, d, "documents").select("doc_id"), metrics, "doc_id", "r1", "quality", descending=True).limit(50)


@query("SELECT c_custkey, max(CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS pair_value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def order_by_pair_metric(s, d):
    pairs = read(s, d, "orders").select(F.col("o_custkey").alias("gt_id"), F.lit(None).cast("long").alias("pred_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value"))
    return ordering.pair_metric(read(s, d, "customer").select("c_custkey"), pairs, "c_custkey", "gt_id")


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n_samples FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def collections_overview(s, d):
    return facets.overview(read(s, d, "nation").select("n_nationkey", "n_name"), read(s, d, "customer"), "n_nationkey", "c_nationkey")


@query("""WITH n AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS k FROM embeddings),
e AS (SELECT label, p // 5 AS chunk, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM n WHERE p < k - k % 5)
SELECT label, CAST(chunk AS INTEGER) AS chunk, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY ALL""")
def sequence_mean_vectors(s, d):
    chunked = ordering.chunks(read(s, d, "embeddings"), "label", "vec_id", 5)
    means = selection.mean_vectors(chunked, ["label", "chunk"], "embedding")
    return means.select("label", "chunk", F.posexplode("embedding").alias("place", "x")).select("label", "chunk", "place", F.round("x", 6).alias("mean"))
