"""More queries of the core operators: whole filters, views, evaluation, selection, catalog changes, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import masks
from sievework.functions import metadata as M
from sievework.operators import catalog, embeddings, evaluate, fewshot, filters, ordering, selection, views
from sievework.plans.registry import query, read
from sievework.sources import writers

#: Examples of each class that the few-shot queries train on: those of the least ids.
EXAMPLES = 20


def _annotations(s, d):
    """Lines as annotations of orders; the id tells rows of one order and line apart by all they hold."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return read(s, d, "lineitem").select(key.alias("id"), F.col("l_orderkey").alias("parent"), F.col("l_linestatus").alias("kind"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.col("l_returnflag").alias("label"))


_ANN = "(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS parent, l_linestatus AS kind, 's' || (l_suppkey % 3) AS source, l_returnflag AS label FROM lineitem)"


# Whole filters -----------------------------------------------------------------------------------


@query(f"SELECT id, parent FROM {_ANN} WHERE kind = 'O' AND source IN ('s0', 's2') AND label IN ('N', 'R') AND parent IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def filter_annotations(s, d):
    rows = _annotations(s, d)
    region = rows.join(read(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("parent")), "parent", "left_semi").select("id")
    return filters.AnnotationsFilter(kinds=["O"], sources=["s0", "s2"], labels=["N", "R"], region=region).apply(rows).select("id", "parent")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def filter_parents_unset(s, d):
    return filters.AnnotationsFilter().apply_to_parents(read(s, d, "orders"), _annotations(s, d), "o_orderkey").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 300000 AND o_orderkey IN (SELECT parent FROM {_ANN} WHERE label = 'R') AND o_orderkey NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'")
def filter_samples(s, d):
    links = read(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tag"))
    captions = read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("o_orderkey"))
    wanted = filters.SampleFilter(tags=["1-URGENT", "2-HIGH"], links=links, annotations=(filters.AnnotationsFilter(labels=["R"]), _annotations(s, d)), captioned=False, captions=captions, ranges={"o_totalprice": (100000, 300000)}, test=F.col("o_orderstatus") != "P")
    return wanted.ids_of(read(s, d, "orders"), "o_orderkey")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT parent FROM {_ANN} WHERE label = 'A') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT parent FROM {_ANN} WHERE label = 'A'))")
def filter_frame_or_direct(s, d):
    return filters.frame_or_direct(read(s, d, "customer"), read(s, d, "orders"), _annotations(s, d), filters.AnnotationsFilter(labels=["A"]), "c_custkey", "o_orderkey", "o_custkey").select("c_custkey")


_PAIRS = """(SELECT l_orderkey AS sample, CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey END AS gt_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey END AS pred_id,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS gt_label, CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS pred_label, 'iou' AS metric, l_discount AS value FROM lineitem)"""


def _pairs(s, d):
    gt, pred = F.col("l_linenumber") % 4 != 0, F.col("l_linenumber") % 3 != 0
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.when(gt, F.col("l_partkey")).alias("gt_id"), F.when(pred, F.col("l_suppkey")).alias("pred_id"), F.when(gt, F.col("l_returnflag")).alias("gt_label"), F.when(pred, F.col("l_linestatus")).alias("pred_label"), F.lit("iou").alias("metric"), F.col("l_discount").alias("value"))


@query(f"SELECT DISTINCT sample FROM {_PAIRS} WHERE gt_label = 'R' AND pred_label IS NULL")
def confusion_cell_margin(s, d):
    return filters.confusion_cell(_pairs(s, d), "R", None)


@query(f"SELECT DISTINCT a.sample FROM {_PAIRS} a WHERE gt_label = 'N' AND pred_label = 'O' AND EXISTS (SELECT 1 FROM {_PAIRS} b WHERE b.sample = a.sample AND b.gt_id IS NOT DISTINCT FROM a.gt_id AND b.pred_id IS NOT DISTINCT FROM a.pred_id AND b.metric = 'iou' AND b.value > 0.08)")
def eval_pair_confusion(s, d):
    return filters.pair_samples(_pairs(s, d), "confusion", "N", "O", [(F.col("metric") == "iou") & (F.col("value") > 0.08)])


@query(f"SELECT DISTINCT sample FROM {_PAIRS} WHERE gt_id IS NULL AND pred_label = 'F'")
def eval_pair_false_positive(s, d):
    return filters.pair_samples(_pairs(s, d), "false_positive", prediction="F")


@query(f"SELECT DISTINCT sample FROM {_PAIRS} WHERE pred_id IS NULL AND gt_label = 'A'")
def eval_pair_false_negative(s, d):
    return filters.pair_samples(_pairs(s, d), "false_negative", truth="A")


def _run_metrics(s, d):
    a = read(s, d, "lineitem").select((F.col("l_suppkey") % 2).alias("run"), F.col("l_orderkey").alias("sample"), F.lit("f1").alias("metric"), F.col("l_discount").alias("value"))
    b = read(s, d, "lineitem").select((F.col("l_suppkey") % 2).alias("run"), F.col("l_orderkey").alias("sample"), F.lit("miou").alias("metric"), F.col("l_tax").alias("value"))
    return a.unionByName(b)


@query("""WITH m AS (SELECT l_suppkey % 2 AS run, l_orderkey AS sample, 'f1' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_suppkey % 2, l_orderkey, 'miou', l_tax FROM lineitem),
r AS (SELECT 0 AS dataset, 0 AS run, 'first' AS name UNION ALL SELECT 1, 1, 'first' UNION ALL SELECT 1, 0, 'second')
SELECT o_orderkey AS sample FROM orders WHERE EXISTS (SELECT 1 FROM r JOIN m USING (run) WHERE name = 'first' AND dataset = o_custkey % 2 AND m.sample = o_orderkey)
AND EXISTS (SELECT 1 FROM r JOIN m USING (run) WHERE name = 'first' AND dataset = o_custkey % 2 AND m.sample = o_orderkey AND metric = 'f1' AND value > 0.05)
AND EXISTS (SELECT 1 FROM r JOIN m USING (run) WHERE name = 'first' AND dataset = o_custkey % 2 AND m.sample = o_orderkey AND metric = 'miou' AND value <= 0.04)""")
def eval_sample_predicate(s, d):
    runs = s.createDataFrame([(0, 0, "first"), (1, 1, "first"), (1, 0, "second")], "dataset long, run long, name string")
    samples = read(s, d, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 2).alias("dataset"))
    return filters.metric_samples(runs, _run_metrics(s, d), samples, "first", [("f1", ">", 0.05), ("miou", "<=", 0.04)]).select("sample")


@query("SELECT l_suppkey % 2 AS run, metric, min(CASE metric WHEN 'f1' THEN l_discount ELSE l_tax END) AS low, max(CASE metric WHEN 'f1' THEN l_discount ELSE l_tax END) AS high FROM lineitem, (SELECT unnest(['f1', 'miou']) AS metric) GROUP BY 1, 2")
def eval_metric_bounds(s, d):
    return evaluate.metric_bounds(_run_metrics(s, d))


@query("WITH r AS (SELECT 0 AS run, 'a' AS truth, 'b' AS predicted UNION ALL SELECT 1, 'a', 'c'), m AS (SELECT l_suppkey % 2 AS run, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'iou' || (l_linenumber % 2) END AS metric FROM lineitem) SELECT DISTINCT run, metric FROM m WHERE metric IS NOT NULL AND run IN (SELECT run FROM r WHERE truth = 'b' OR predicted = 'b')")
def eval_metric_names(s, d):
    runs = s.createDataFrame([(0, "a", "b"), (1, "a", "c")], "run long, truth string, predicted string")
    metric = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("iou"), (F.col("l_linenumber") % 2).cast("string")))
    return evaluate.metric_names(runs, read(s, d, "lineitem").select((F.col("l_suppkey") % 2).alias("run"), metric.alias("metric")), "b")


# Views -------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT l_orderkey, list_sort(list({'label': l_returnflag, 'part': l_partkey})) AS a FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey, [o_orderpriority] AS tags FROM orders)
SELECT o.o_orderkey, array_to_string(t.tags, ',') AS tags, coalesce(array_to_string([x.label || ':' || x.part for x in n.a], ','), '') AS annotations FROM orders o JOIN t USING (o_orderkey) LEFT JOIN n ON l_orderkey = o.o_orderkey""")
def view_nested(s, d):
    tags = read(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tag"))
    lines = read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("part"))
    made = views.nested(read(s, d, "orders").select("o_orderkey"), "o_orderkey", tags=(tags, ["tag"]), annotations=(lines, ["label", "part"]))
    shown = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["label"], a["part"].cast("string"))), ",")
    return made.select("o_orderkey", F.array_join("tags", ",").alias("tags"), shown.alias("annotations"))


@query(f"SELECT id, CASE WHEN o.o_orderkey IS NOT NULL THEN 'image' WHEN c.c_custkey IS NOT NULL THEN 'frame' END AS kind, coalesce(o.o_orderstatus, c.c_name) AS path FROM {_ANN} a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o_orderkey = parent LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 1) c ON c_custkey = parent")
def annotation_payload(s, d):
    images = read(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("path"))
    frames = read(s, d, "customer").where("c_custkey % 2 = 1").select("c_custkey", F.col("c_name").alias("path"))
    made = views.with_payload(_annotations(s, d), "parent", ("image", images, "o_orderkey", ["path"]), ("frame", frames, "c_custkey", ["path"]))
    return made.select("id", "payload.kind", "payload.path")


@query(f"SELECT id, coalesce(o.o_orderstatus, c.c_name, '') AS path FROM {_ANN} a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o_orderkey = parent LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 1) c ON c_custkey = parent ORDER BY path, id LIMIT 100")
def annotation_list(s, d):
    images = read(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("path"))
    frames = read(s, d, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("path"))
    return views.listed(_annotations(s, d), "parent", images, frames).select("id", "path").orderBy("path", "id").limit(100)


@query("SELECT place, vec_id, label FROM (SELECT vec_id AS id, 1000000 - vec_id AS place FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT -1, 0) i JOIN embeddings ON vec_id = id")
def vectors_in_given_order(s, d):
    ids = read(s, d, "embeddings").where("vec_id % 7 = 0").select(F.col("vec_id").alias("id"), (1000000 - F.col("vec_id")).alias("place"))
    return views.in_given_order(read(s, d, "embeddings"), "vec_id", ids.unionByName(s.createDataFrame([(-1, 0)], "id long, place long"))).select("place", "vec_id", "label")


@query("SELECT o_orderkey AS id, coalesce(n, '') AS names FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def label_names_by_id(s, d):
    ids = read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return views.names_by_id(ids, read(s, d, "lineitem"), "l_orderkey", "l_returnflag").select("id", F.array_join("names", ",").alias("names"))


@query("SELECT p_name AS path, count(*) OVER () AS total FROM part WHERE p_size > 20")
def export_paths(s, d):
    return views.paths_with_total(read(s, d, "part").where("p_size > 20"), "p_name", "p_partkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 3)")
def frames_of_videos(s, d):
    turns = read(s, d, "conversations")
    return filters.among(turns, "conv_id", turns.where("turn = 3").select("conv_id")).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT d.doc_id FROM documents d JOIN (SELECT 'doc-' || item_id AS p FROM benchmark) b ON 'doc-' || d.doc_id = b.p")
def ids_by_path(s, d):
    docs = read(s, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    return filters.among(docs, "path", read(s, d, "benchmark").select(F.concat(F.lit("doc-"), F.col("item_id").cast("string")))).select("doc_id")


# Metadata ----------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a b\":{\"x\":[1,2.5,true]},\"k\":\"new\",\"t\":false}' WHEN event_id % 3 = 1 THEN '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":1.5}' ELSE props END AS props FROM events")
def metadata_upsert(s, d):
    old = read(s, d, "events").select("event_id", "props")
    a = old.where("event_id % 3 = 0").select("event_id", F.lit('{"k": "new", "t": false, "a b": {"x": [1, 2.5, true]}}').alias("props"))
    b = old.where("event_id % 3 = 1").select("event_id", F.lit('{"n": 1.5}').alias("props"))
    return M.upsert(old, a.unionByName(b), "event_id", "props")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_read_typed(s, d):
    return read(s, d, "events").select("event_id", M.typed(F.col("props"), "k", "integer").alias("k"))


@query("SELECT key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kind, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT unnest(json_keys(props)) AS key, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' END AS kind FROM events) GROUP BY key")
def metadata_types(s, d):
    return M.key_types(read(s, d, "events"), "props").select("key", "kind", F.array_join("kinds", ",").alias("kinds"))


@query("WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events), b AS (SELECT min(v) AS lo, max(v) AS hi FROM e) SELECT 'k' AS key, CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM e, b GROUP BY 2")
def metadata_histograms(s, d):
    return M.key_histograms(read(s, d, "events"), "props")


# Masks and boxes -----------------------------------------------------------------------------------

_MASKED = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 15 AS BIGINT) AS x, CAST(l_suppkey % 11 AS BIGINT) AS y, CAST(l_quantity % 9 AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS h FROM lineitem)"


def _masked(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 15).alias("x"), (F.col("l_suppkey") % 11).alias("y"), (F.col("l_quantity") % 9).cast("long").alias("w"), F.col("l_linenumber").cast("long").alias("h"))
    return rows.withColumn("rle", masks.box_runs(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(20).cast("long"), F.lit(14).cast("long")))


_CUT = "greatest(least(x + w, 20) - x, 0) AS cw, greatest(least(y + h, 14) - y, 0) AS ch"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cw * ch AS area, CASE WHEN cw * ch > 0 THEN x ELSE 0 END AS x, CASE WHEN cw * ch > 0 THEN y ELSE 0 END AS y, CASE WHEN cw * ch > 0 THEN cw ELSE 0 END AS width, CASE WHEN cw * ch > 0 THEN ch ELSE 0 END AS height FROM (SELECT *, {_CUT} FROM {_MASKED})")
def mask_boxes(s, d):
    rows = _masked(s, d)
    box = masks.bounding_box(F.col("rle"), F.lit(20).cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", masks.area(F.col("rle")).alias("area"), box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "area", "b.*")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 280 AS n_pixels, cw * ch AS n_set, true AS same FROM (SELECT *, {_CUT} FROM {_MASKED})")
def mask_round_trip(s, d):
    rows = _masked(s, d).withColumn("pixels", masks.decode(F.col("rle")))
    made = rows.withColumn("again", masks.encode(F.col("pixels")))
    same = F.array_join("again", ",") == F.array_join(F.when((F.size("rle") > 1) | (F.col("rle")[0] == 280), F.col("rle")), ",")
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("pixels").alias("n_pixels"), F.size(F.array_remove("pixels", 0)).cast("long").alias("n_set"), same.alias("same"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(x, 0) AS x, y, least(x + w, 20) - greatest(x, 0) AS width, least(y + h, 14) - y AS height FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 30 - 5 AS BIGINT) AS x, CAST(l_suppkey % 20 AS BIGINT) AS y, CAST(l_quantity % 9 AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS h FROM lineitem) WHERE least(x + w, 20) > greatest(x, 0) AND least(y + h, 14) > y")
def crop_boxes(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 30 - 5).alias("x"), (F.col("l_suppkey") % 20).alias("y"), (F.col("l_quantity") % 9).cast("long").alias("width"), F.col("l_linenumber").cast("long").alias("height"), F.lit(20).cast("long").alias("image_width"), F.lit(14).cast("long").alias("image_height"))
    return embeddings.crop_boxes(rows).drop("image_width", "image_height")


@query(f"SELECT id, o_orderpriority AS path FROM {_ANN} JOIN orders ON o_orderkey = parent WHERE kind = 'F' AND label <> 'A'")
def unembedded_annotations(s, d):
    rows = _annotations(s, d).withColumnRenamed("parent", "sample")
    images = read(s, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("path"))
    return embeddings.missing(rows, images, rows.where("label = 'A'").select("id"), ("F",))


@query("SELECT n, CAST(n AS VARCHAR) || '-' || CAST(s AS VARCHAR) || '-' || CAST(x AS VARCHAR) AS fingerprint FROM (SELECT count(*) AS n, sum(m) AS s, bit_xor(m) AS x FROM (SELECT CAST('0x' || substr(md5(vec_id || '|' || array_to_string([CAST(round(CAST(v AS DOUBLE) * 10000) AS BIGINT) for v in embedding], ',')), 1, 8) AS BIGINT) AS m FROM embeddings))")
def embedding_fingerprint(s, d):
    return embeddings.fingerprint(read(s, d, "embeddings"))


@query()
def model_vectors(s, d):
    models = embeddings.Models()
    models.register("hashed", embeddings.hashed_model(8), 8)
    return models.embed(read(s, d, "part"), "p_name", "p_partkey")


# Selection and few-shot --------------------------------------------------------------------------------


def _flags(s, d):
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("labels"))


@query()
def select_balanced_uniform(s, d):
    chosen = read(s, d, "orders").where("o_orderkey % 5000 = 0").join(_flags(s, d).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return selection.select(_flags(s, d), 40, "l_orderkey", selection.Strategy(balance="uniform"), chosen)


@query()
def select_balanced_input(s, d):
    return selection.select(_flags(s, d), 40, "l_orderkey", selection.Strategy(balance="input"))


@query()
def select_diverse_weighted(s, d):
    rows = read(s, d, "embeddings").withColumn("w", (F.col("vec_id") % 10).cast("double"))
    return selection.select(rows, 40, "vec_id", selection.Strategy(weights=[("w", 0.5)], vector="embedding"), rows.where("vec_id % 100 = 0").select("vec_id"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS INTEGER) AS step FROM part WHERE p_partkey % 9 <> 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def select_weighted_after_chosen(s, d):
    part = read(s, d, "part")
    return selection.select(part, 30, "p_partkey", selection.Strategy(weights=[("p_retailprice", 1.0)]), part.where("p_partkey % 9 = 0").select("p_partkey"))


@query()
def select_sequences(s, d):
    return selection.sequences(read(s, d, "embeddings"), 60, 5, "vec_id", "label", "vec_id", "embedding")


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, 'old' AS tag FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey, 'picked' FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30))")
def select_into_tag(s, d):
    part = read(s, d, "part")
    picked = selection.select(part, 30, "p_partkey", selection.Strategy(weights=[("p_retailprice", 1.0)]))
    return selection.tag_result(part.where("p_size = 1").select("p_partkey", F.lit("old").alias("tag")), picked, "p_partkey", "picked")


def _forest(s, d):
    from pyspark.sql import Window

    rows = read(s, d, "embeddings").withColumn("label", F.col("label").cast("string"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    examples = rows.withColumn("p", place).where(F.col("p") <= EXAMPLES).where("label <> '9'")
    return rows, examples, fewshot.train(examples, [str(i) for i in range(10)])


@query()
def few_shot_probabilities(s, d):
    rows, _, made = _forest(s, d)
    return fewshot.predict(made, rows)


@query()
def few_shot_annotations(s, d):
    rows, _, made = _forest(s, d)
    old = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("sample"), F.lit(0).alias("label"), F.lit(0.5).alias("confidence"), F.lit("forest").alias("source"))
    labels = s.createDataFrame([(0, "0"), (7, "other")], "id int, name string")
    return fewshot.annotate(made, rows, old, labels, "forest")[0]


@query()
def few_shot_review(s, d):
    rows, examples, made = _forest(s, d)
    return fewshot.to_review(made, rows, examples)


@query("SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '3' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def few_shot_relabelled(s, d):
    rows = read(s, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return fewshot.relabelled(rows, rows.where("vec_id % 11 = 0").select("vec_id", F.lit("3").alias("label")), [str(i) for i in range(10)])


# Catalog ---------------------------------------------------------------------------------------------


@query("SELECT CASE r_name WHEN 'ASIA' THEN 'FAR EAST' ELSE r_name END AS r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'")
def tag_rename_and_delete(s, d):
    tags = catalog.rename_tag(read(s, d, "region"), "ASIA", "FAR EAST", "r_name")
    kept, links = catalog.delete_tag(tags, read(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "EUROPE", "r_regionkey", "r_name")
    return kept.join(links, "r_regionkey").select("r_name", "n_name")


@query("WITH n AS (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#3')) SELECT 5 AS id, 'Brand#3' AS name UNION ALL SELECT 9, 'Brand#1' UNION ALL SELECT CAST(9 + row_number() OVER (ORDER BY p_brand) AS INTEGER), p_brand FROM n")
def label_get_or_create(s, d):
    held = s.createDataFrame([(5, "Brand#3"), (9, "Brand#1")], "id int, name string")
    return catalog.get_or_create(held, read(s, d, "part").select(F.col("p_brand").alias("name")), "name", "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'checked' ELSE o_orderstatus END AS name FROM orders")
def annotation_relabel(s, d):
    rows = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"))
    dimension = s.createDataFrame([(0, "F"), (1, "O"), (2, "P")], "label int, name string")
    made, grown = catalog.relabel(rows, dimension, rows.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("checked").alias("name")), "o_orderkey", "label", "name")
    return made.join(grown, "label").select("o_orderkey", "name")


@query("SELECT doc_id, text FROM (SELECT doc_id, source AS text FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 10 = 0)")
def caption_changes(s, d):
    docs = read(s, d, "documents")
    changes = docs.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "again").alias("text"))
    return catalog.put_captions(docs.select("doc_id", F.col("source").alias("text")), changes, "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS c_custkey FROM orders")
def track_attach(s, d):
    orders, tracks = read(s, d, "orders"), read(s, d, "customer").select("c_custkey")
    links = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return catalog.attach_tracks(orders.select("o_orderkey"), tracks.unionByName(links.select("c_custkey")).distinct(), links, "o_orderkey", "c_custkey")


@query("SELECT 'found' AS what, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND quality = 1 UNION ALL SELECT 'covered', count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unknown', count(*) FROM benchmark")
def attach_annotations(s, d):
    samples = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"))
    given = read(s, d, "labels").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("quality") == 1, "good").alias("label"))
    lost = read(s, d, "benchmark").select(F.concat(F.lit("/none/"), F.col("item_id").cast("string")).alias("path"), F.lit("good").alias("label"))
    found, covered, unknown = catalog.attach(samples, given.unionByName(lost), "id", "path", "made")
    count = lambda rows, what: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(found, "found").unionByName(count(covered, "covered")).unionByName(count(unknown, "unknown"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def dataset_delete(s, d):
    tables = {n: read(s, d, n) for n in ("customer", "orders", "lineitem")}
    edges = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = catalog.delete_scope(tables, edges, "customer", F.col("c_mktsegment") == "BUILDING")
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, rows in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT sha256('copy:nation:' || n_nationkey) AS n_nationkey, sha256('copy:region:' || n_regionkey) AS n_regionkey, replace(n_name, 'NATION', 'COPY') AS n_name FROM nation")
def dataset_deep_copy(s, d):
    region = read(s, d, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    nation = read(s, d, "nation").withColumns({"n_nationkey": F.col("n_nationkey").cast("string"), "n_regionkey": F.col("n_regionkey").cast("string")})
    made = catalog.deep_copy({"region": region, "nation": nation}, {"region": "r_regionkey", "nation": "n_nationkey"}, [("nation", "n_regionkey", "region")], "copy")
    return made["nation"].select("n_nationkey", "n_regionkey", catalog.copy_name(F.col("n_name"), "NATION", "COPY").alias("n_name"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN user_id % 10 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY user_id) > 1 THEN 'ALREADY_PRESENT' WHEN user_id % 10 = 1 THEN 'MISSING' WHEN user_id % 10 = 2 THEN 'BROKEN' ELSE 'ADDED' END AS outcome FROM events) GROUP BY 1")
def file_outcomes(s, d):
    files = read(s, d, "events").select(F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"), "user_id")
    known = files.where("user_id % 10 = 0").select("path").distinct()
    return catalog.outcome_report(catalog.outcomes(files, known, "path", F.col("user_id") % 10 != 2, F.col("user_id") % 10 != 1))


# Exports ----------------------------------------------------------------------------------------------


@query("SELECT image_id, row_number() OVER (ORDER BY image_id, caption) - 1 AS id, caption FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, doc_id FROM (SELECT doc_id, 'doc-' || doc_id AS path FROM documents)) JOIN (SELECT doc_id, CAST(quality AS VARCHAR) || source AS caption FROM labels JOIN documents USING (doc_id)) USING (doc_id)")
def export_captions(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("sample"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_path_abs"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    texts = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("sample"), F.concat(F.col("quality").cast("string"), F.col("source")).alias("text"))
    return writers.caption_tables(docs, texts)[1]


@query("""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS spot, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
v AS (SELECT conv_id, k, row_number() OVER (ORDER BY 'v' || conv_id) AS video_id FROM (SELECT DISTINCT conv_id, k FROM f)),
t AS (SELECT conv_id, role, list(spot) AS held FROM (SELECT f.conv_id, spot, role FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn) GROUP BY 1, 2),
g AS (SELECT DISTINCT role FROM conversations), c AS (SELECT role, row_number() OVER (ORDER BY role) AS category_id FROM g)
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(category_id AS INTEGER) AS category_id, array_to_string([CASE WHEN list_contains(held, i) THEN '1' ELSE '0' END for i in range(k)], '') AS seen FROM t JOIN v USING (conv_id) JOIN c USING (role)""")
def export_tracks(s, d):
    turns = read(s, d, "conversations")
    videos = turns.select(F.col("conv_id").alias("video")).distinct().select("video", F.concat(F.lit("v"), F.col("video").cast("string")).alias("path"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    frames = turns.select(key.alias("frame"), F.col("conv_id").alias("video"), F.col("turn").alias("number"))
    objects = turns.select(key.alias("frame"), F.col("role").alias("track"), F.col("role").alias("label"), *[F.lit(1).alias(c) for c in ("x", "y", "width", "height")], F.array(F.lit(5), F.lit(1), F.lit(10)).alias("rle"))
    made = writers.track_tables(videos, frames, objects, turns.select(F.col("role").alias("label")))[2]
    return made.select("video_id", "category_id", F.array_join(F.transform("segmentations", lambda x: F.when(x.isNull(), "0").otherwise("1")), "").alias("seen"))


@query("SELECT vec_id, previous, following FROM (SELECT vec_id, lag(vec_id) OVER (ORDER BY label, vec_id) AS previous, lead(vec_id) OVER (ORDER BY label, vec_id) AS following FROM embeddings) WHERE vec_id % 100 = 0")
def neighbours_of_many(s, d):
    rows = read(s, d, "embeddings")
    return ordering.neighbours_of(rows, ["label", "vec_id"], rows.where("vec_id % 100 = 0").select("label", "vec_id")).select("vec_id", "previous", "following")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def random_sample(s, d):
    return ordering.random_rows(read(s, d, "documents").select("doc_id", "lang"), 50, "doc_id", seed=7)
