"""Queries of image headers, masks, plots, deep trees and box matching, over tables as the files and boxes of a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import images, masks
from sievework.operators import catalog, evaluate, plot, projection, selection
from sievework.operators.scratch import cut
from sievework.plans.registry import query, read
from sievework.sources import png_masks

_FORMATS = ("png", "gif", "bmp", "webp", "tiff", "jpeg")


def _hex(value, size: int, little: bool = False):
    """A number as hexadecimal bytes."""
    full = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(full, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]) if little else full


def _files(s, d):
    """Parts as image files: the format by the key, the width by the size, the height by the price; every 20th file is cut short."""
    w, h = F.col("p_size") + 1, F.floor(F.col("p_retailprice")) % 5000 + 1
    chunk = F.concat(F.lit(b"IHDR".hex()), _hex(w, 4), _hex(h, 4), F.lit("0803000000"))
    made = (
        F.concat(F.lit(png_masks.SIGNATURE.hex() + "0000000d"), chunk, _hex(F.crc32(F.unhex(chunk)), 4)),
        F.concat(F.lit(b"GIF89a".hex()), _hex(w, 2, True), _hex(h, 2, True)),
        F.concat(F.lit(b"BM".hex() + "00" * 12 + "28000000"), _hex(w, 4, True), _hex(h, 4, True)),
        F.concat(F.lit((b"RIFF\0\0\0\0WEBPVP8X" + bytes(8)).hex()), _hex(w - 1, 3, True), _hex(h - 1, 3, True)),
        F.concat(F.lit(b"MM\0*\0\0\0\x08\0\x02\x01\0\0\x03\0\0\0\x01".hex()), _hex(w, 2), F.lit("0000" + b"\x01\x01\0\x04\0\0\0\x01".hex()), _hex(h, 4)),
        F.concat(F.lit((b"\xff\xd8\xff\xe0\0\x10" + bytes(14) + b"\xff\xc0\0\x11\x08").hex()), _hex(h, 2), _hex(w, 2)),
    )
    which = F.col("p_partkey") % 6
    raw = F.lit(None).cast("string")
    for i, m in enumerate(made):
        raw = F.when(which == i, m).otherwise(raw)
    content = F.unhex(F.when(F.col("p_partkey") % 20 == 7, F.substring(raw, 1, 20)).otherwise(raw))
    # Written once, as files are: else the bytes' making would stand in the plan wherever the parser looks at one.
    return cut(read(s, d, "part").repartition("p_partkey").select("p_partkey", F.concat(F.lit("/img/"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content")))


_SIZES = "(SELECT p_partkey, '/img/' || p_partkey AS path, p_size + 1 AS w, CAST(floor(p_retailprice) AS BIGINT) % 5000 + 1 AS h, p_partkey % 20 = 7 AS cut, ['png', 'gif', 'bmp', 'webp', 'tiff', 'jpeg'][p_partkey % 6 + 1] AS format FROM part)"


@query(f"SELECT p_partkey, CASE WHEN NOT cut THEN format END AS format, CAST(CASE WHEN NOT cut THEN w END AS INTEGER) AS width, CAST(CASE WHEN NOT cut THEN h END AS INTEGER) AS height FROM {_SIZES} WHERE NOT (cut AND format = 'gif') UNION ALL SELECT p_partkey, 'gif', CAST(w AS INTEGER), CAST(h AS INTEGER) FROM {_SIZES} WHERE cut AND format = 'gif'")
def image_headers(s, d):
    return _files(s, d).select("p_partkey", images.header(F.col("content")).alias("h")).select("p_partkey", "h.format", "h.width", "h.height")


@query(f"""WITH wanted AS (SELECT '/img/' || l_partkey AS path, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT '/gone/' || s_suppkey, 1 FROM supplier),
o AS (SELECT w.n, f.path IS NULL AS gone, f.cut AND f.format <> 'gif' AS broken, coalesce(f.p_partkey % 10 = 0, false) AS known FROM wanted w LEFT JOIN {_SIZES} f ON f.path = w.path)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN known THEN 'ALREADY_PRESENT' WHEN gone THEN 'MISSING' WHEN broken THEN 'BROKEN' ELSE 'ADDED' END AS outcome, CASE WHEN known OR gone OR broken THEN n ELSE 1 END AS n FROM o
  UNION ALL SELECT 'ALREADY_PRESENT', n - 1 FROM o WHERE NOT known AND NOT gone AND NOT broken AND n > 1) GROUP BY 1""")
def image_outcomes(s, d):
    files = _files(s, d).select("path", "p_partkey", images.header(F.col("content")).alias("h")).select("path", "p_partkey", "h.width", "h.height")
    wanted = read(s, d, "lineitem").select(F.concat(F.lit("/img/"), F.col("l_partkey").cast("string")).alias("path"))
    wanted = wanted.unionByName(read(s, d, "supplier").select(F.concat(F.lit("/gone/"), F.col("s_suppkey").cast("string")).alias("path")))
    return catalog.outcome_report(catalog.add_images(wanted, files, files.where("p_partkey % 10 = 0"))[1])


def _painted(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 15).alias("x"), (F.col("l_suppkey") % 11).alias("y"), (F.col("l_quantity") % 9).cast("long").alias("w"), F.col("l_linenumber").cast("long").alias("h"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(x + w, 20) - x, 0) * greatest(least(y + h, 14) - y, 0) AS area FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 15 AS BIGINT) AS x, CAST(l_suppkey % 11 AS BIGINT) AS y, CAST(l_quantity % 9 AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS h FROM lineitem)")
def mask_polygons(s, d):
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    # Two halves of a rectangle, which share an edge.
    halves = F.array(F.array(x, y, right, y, right, low), F.array(x, y, right, low, x, low)).cast("array<array<double>>")
    runs = masks.polygon_runs(halves, F.lit(20), F.lit(14))
    return _painted(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", masks.area(runs).alias("area"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS c, CAST(l_partkey % 15 AS BIGINT) AS x, CAST(l_suppkey % 11 AS BIGINT) AS y, CAST(l_quantity % 9 AS BIGINT) AS w FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, c, unnest(range(y, least(y + l_linenumber, 14))) AS row, x, least(x + w, 20) AS stop FROM m),
p AS (SELECT l_orderkey, row, unnest(range(x, stop)) AS col, l_linenumber, c FROM r WHERE x < stop),
t AS (SELECT l_orderkey, arg_max(c, (l_linenumber, c)) AS class_id FROM p GROUP BY l_orderkey, row, col),
n AS (SELECT l_orderkey, class_id, count(*) AS area FROM t GROUP BY ALL)
SELECT l_orderkey, CAST(class_id AS INTEGER) AS class_id, area FROM n
UNION ALL SELECT o.l_orderkey, 0, 280 - coalesce(a, 0) FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN (SELECT l_orderkey, CAST(sum(area) AS BIGINT) AS a FROM n GROUP BY 1) x ON x.l_orderkey = o.l_orderkey WHERE coalesce(a, 0) < 280""")
def mask_png_round_trip(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("class_id"), (F.col("l_partkey") % 15).alias("x"), (F.col("l_suppkey") % 11).alias("y"), (F.col("l_quantity") % 9).cast("long").alias("w"))
    runs = masks.box_runs(F.col("x"), F.col("y"), F.col("w"), F.col("l_linenumber").cast("long"), F.lit(20).cast("long"), F.lit(14).cast("long"))
    painted = png_masks.to_png(rows.select("l_orderkey", F.lit(20).alias("width"), F.lit(14).alias("height"), F.col("l_linenumber").alias("at"), "class_id", runs.alias("rle")), ["l_orderkey"])
    return png_masks.from_png(painted, "l_orderkey").select("l_orderkey", "class_id", masks.area(F.col("rle")).alias("area"))


@query("""WITH RECURSIVE c AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up FROM orders),
t AS (SELECT o_orderkey, o_orderkey AS root, 0 AS level FROM c WHERE up IS NULL UNION ALL SELECT c.o_orderkey, t.root, t.level + 1 FROM c JOIN t ON c.up = t.o_orderkey)
SELECT o_orderkey, root, CAST(level AS INTEGER) AS level FROM t""")
def tree_of_any_depth(s, d):
    from pyspark.sql import Window

    up = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return catalog.hierarchy(read(s, d, "orders").select("o_orderkey", up.alias("up"), F.lit("x").alias("name")), "o_orderkey", "up", "name").select("o_orderkey", "root", "level")


@query("""WITH v AS (SELECT p_partkey AS key, p_brand || '-' || p_size AS value FROM part), n AS (SELECT value, count(*) AS n FROM v JOIN part ON p_partkey = key WHERE p_size > 10 GROUP BY 1),
r AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) AS r, count(*) OVER () AS k FROM n)
SELECT key AS p_partkey, CAST(CASE WHEN r IS NULL THEN NULL WHEN k <= 253 OR r <= 252 THEN r + 2 ELSE 255 END AS INTEGER) AS slot FROM v LEFT JOIN r USING (value)""")
def plot_colours(s, d):
    part = read(s, d, "part")
    values = part.select(F.col("p_partkey").alias("key"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("value"))
    scale, _ = plot.frequency_scale(values, part.where("p_size > 10").select(F.col("p_partkey").alias("key")))
    return plot.categories(values.select("key"), values, scale).select(F.col("key").alias("p_partkey"), F.get("categories", F.lit(0)).alias("slot"))


@query("""WITH n AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, CAST(label AS VARCHAR)) + 2 AS slot FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label)
SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(vec_id % 3 = 0 AS INTEGER) AS passes, CAST(slot AS VARCHAR) AS slots FROM embeddings LEFT JOIN n USING (label)""")
def plot_stream(s, d):
    rows = read(s, d, "embeddings")
    points = rows.select(F.col("vec_id").alias("key"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    matching = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("key"))
    values = rows.select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    scale, legend = plot.frequency_scale(values, matching)
    sent = plot.messages(points, legend, matching, plot.categories(points, values, scale))
    shape = plot.schema(legend)

    def back(batches):
        import pyarrow as pa

        for batch in batches:
            for message in batch.column(0).to_pylist():
                rows = pa.ipc.read_record_batch(pa.py_buffer(message), shape)
                slots = pa.array([None if not x else ",".join(map(str, x)) for x in rows.column("color_categories").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("sample_id"), rows.column("x"), rows.column("y"), rows.column("fulfils_filter").cast(pa.int32()), slots], ["sample_id", "x", "y", "passes", "slots"])

    inner = sent.where(F.col("part").between(0, (1 << 62) - 1)).select("message")
    return inner.mapInArrow(back, "sample_id string, x float, y float, passes int, slots string")


def _boxes(s, d, shift: int):
    """Lines as boxes of their orders; the id has all that tells two of them apart."""
    x, w, c = F.col("l_partkey") % 50 + shift, F.col("l_quantity").cast("long") + 1, F.round(F.col("l_discount") * 100).cast("long")
    name = F.concat_ws("-", *[v.cast("string") for v in (F.col("l_orderkey") * 10 + F.col("l_linenumber"), x, F.col("l_suppkey") % 10, w, c)])
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("sample"), name.alias("id"), F.col("l_returnflag").alias("label"), x.alias("x"), (F.col("l_suppkey") % 10).alias("y"), w.alias("width"), F.lit(20).alias("height"), c.cast("double").alias("confidence"))


# Predictions take their turns one by one; each has its overlapping boxes, best first, and takes the first that is free.
_TURNS = """WITH RECURSIVE b AS (SELECT l_orderkey AS sample, l_returnflag AS label, l_orderkey * 10 + l_linenumber AS n, l_partkey % 50 AS x, l_suppkey % 10 AS y, CAST(l_quantity AS BIGINT) + 1 AS w, CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY sample, label ORDER BY id) AS i FROM (SELECT *, concat_ws('-', n, x, y, w, c) AS id FROM b)),
p AS (SELECT *, row_number() OVER (PARTITION BY sample, label ORDER BY c DESC, id) AS turn FROM (SELECT sample, label, x + 4 AS x, y, w, c, concat_ws('-', n, x + 4, y, w, c) AS id FROM b)),
o AS (SELECT p.sample, p.label, turn, i, shared / (20.0::DOUBLE * (g.w + p.w) - shared) AS iou FROM (SELECT p.*, g.i, g.w AS gw, greatest(0, least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x)) * greatest(0, least(g.y, p.y) + 20 - greatest(g.y, p.y))::DOUBLE AS shared FROM p JOIN g ON g.sample = p.sample AND g.label = p.label) p JOIN g USING (sample, label, i)),
l AS (SELECT sample, label, turn, list(i ORDER BY iou DESC, i) AS wanted FROM o WHERE iou >= 0.5 GROUP BY ALL),
s AS (SELECT DISTINCT sample, label, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS i FROM p
  UNION ALL SELECT sample, label, turn, CASE WHEN i IS NULL THEN used ELSE list_append(used, i) END, i
  FROM (SELECT p.sample, p.label, p.turn, s.used, list_filter(coalesce(l.wanted, []), lambda x: NOT list_contains(s.used, x))[1] AS i FROM s JOIN p ON p.sample = s.sample AND p.label = s.label AND p.turn = s.turn + 1 LEFT JOIN l ON l.sample = p.sample AND l.label = p.label AND l.turn = p.turn)),
m AS (SELECT sample, label, turn, i FROM s WHERE i IS NOT NULL)
"""


@query(_TURNS + """SELECT p.sample, g.id AS gt_id, p.id AS pred_id, round(o.iou, 9) AS iou FROM p LEFT JOIN m USING (sample, label, turn) LEFT JOIN g ON g.sample = p.sample AND g.label = p.label AND g.i = m.i LEFT JOIN o ON o.sample = p.sample AND o.label = p.label AND o.turn = p.turn AND o.i = m.i
UNION ALL SELECT g.sample, g.id, NULL, NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sample = g.sample AND m.label = g.label AND m.i = g.i)""")
def eval_matched_boxes(s, d):
    return evaluate.match_boxes(_boxes(s, d, 0).drop("confidence"), _boxes(s, d, 4)).select("sample", "gt_id", "pred_id", F.round("iou", 9).alias("iou"))


@query(_TURNS + "SELECT sample, tp, n - tp AS fp, n - tp AS fn FROM (SELECT sample, count(*) AS n FROM b GROUP BY 1) JOIN (SELECT sample, count(i) AS tp FROM p LEFT JOIN m USING (sample, label, turn) GROUP BY 1) USING (sample)")
def eval_counts_per_sample(s, d):
    return evaluate.sample_counts(evaluate.match_boxes(_boxes(s, d, 0).drop("confidence"), _boxes(s, d, 4)))


@query()
def select_combined(s, d):
    how = selection.Strategy(weights=[("w", 0.5)], vector="embedding", strength=1.0, balance="uniform", balance_strength=2.0)
    rows = read(s, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 97).cast("double").alias("w"), F.array(F.col("label").cast("string")).alias("labels"))
    return selection.select(rows, 60, "vec_id", how)


@query()
def projection_map(s, d):
    return projection.project(read(s, d, "embeddings"))
