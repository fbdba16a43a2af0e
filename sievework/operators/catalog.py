"""Dataset tables as immutable snapshots: tags, labels, deletes, copies, hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.scratch import cut


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """A set of links with new ones; those it has already change nothing."""
    return links.unionByName(new.select(*links.columns)).dropDuplicates()


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(*links.columns), links.columns, "left_anti")


def split_known(paths: DataFrame, known: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(new, known) of a list of paths, the first without repeats."""
    return paths.join(known.select(path), path, "left_anti").dropDuplicates([path]), paths.join(known.select(path), path, "left_semi")


def rewrite(rows: DataFrame, test: Column, **values) -> DataFrame:
    """The snapshot with columns changed where the test holds."""
    hit = F.coalesce(test, F.lit(False))
    return rows.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_labels(annotations: DataFrame, label: str, names: list[str]) -> DataFrame:
    if not names:
        raise ValueError("names the labels to delete; none would not mean all")
    return annotations.where(~F.col(label).isin(names) | F.col(label).isNull())


def remap(rows: DataFrame, mapping: DataFrame, column: str, optional: bool = False) -> DataFrame:
    """`rows` with a key column replaced through (old, new); rows whose key has no mapping fail unless optional."""
    joined = rows.join(mapping.select(F.col("old").alias("__o"), F.col("new").alias("__n")), F.col(column) == F.col("__o"), "left")
    bad = F.col(column).isNotNull() & F.col("__n").isNull()
    value = F.col("__n") if optional else F.when(bad, F.raise_error(F.concat(F.lit(f"{column} without a copy: "), F.col(column).cast("string")))).otherwise(F.col("__n"))
    return joined.withColumn(column, value).select(*rows.columns)


def new_ids(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """(old, new): keys of a copy, the same on every evaluation."""
    return rows.select(F.col(key).alias("old"), F.sha2(F.concat_ws(":", F.lit(salt), F.col(key).cast("string")), 256).alias("new"))


def hierarchy(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, root, level, path) of every node of a forest, whatever its depth.

    Pointer doubling: each node holds the stretch from some ancestor down to itself, and a round puts the
    ancestor's own stretch before it, so a chain of n nodes takes log2(n) rounds, each with its lineage cut.
    A loop fails. Nodes whose parent is not there, or below such a node, are left out. A null name
    is left out of the path; keys must differ.
    """
    level = F.lit(0).cast("long").alias("level")
    held = cut(nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(key).alias("root"), F.col(parent).alias("up"), level, F.col(name).cast("string").alias("path")))
    open_, rounds = held.where("up IS NOT NULL").count(), 0
    most = held.count().bit_length() + 1
    while open_:
        if rounds > most:
            loop = held.where("up IS NOT NULL").select("k").first()[0]
            raise ValueError(f"a loop of parents at or above {loop}")
        above = held.select(F.col("k").alias("up"), F.col("root").alias("r"), F.col("up").alias("u"), F.col("level").alias("l"), F.col("path").alias("p"))
        grown = held.where("up IS NOT NULL").join(above, "up").select("k", F.col("r").alias("root"), F.col("u").alias("up"), (F.col("level") + F.col("l") + 1).alias("level"), F.concat_ws("/", "p", "path").alias("path"))
        held = cut(held.where("up IS NULL").unionByName(grown))
        open_, rounds = held.where("up IS NOT NULL").count(), rounds + 1
    return held.select(F.col("k").alias(key), "root", F.col("level").cast("int").alias("level"), "path")


def create_collection(nodes: DataFrame, row: tuple) -> DataFrame:
    """`nodes` (key, parent, name and more) with a further one; a name that its parent has a child of already is an error.

    `row` has the columns' values in order; a null parent makes a root, and roots have different names too.
    """
    made = nodes.sparkSession.createDataFrame([row], nodes.schema)
    same = nodes.join(made.select(F.col("parent").alias("__p"), F.col("name").alias("__n")), F.col("parent").eqNullSafe(F.col("__p")) & (F.col("name") == F.col("__n")), "left_semi")
    if not same.limit(1).isEmpty():
        raise ValueError(f"there is a collection named {made.first()['name']} already")
    parent = made.select(F.col("parent").alias("key")).where(F.col("key").isNotNull())
    if not parent.join(nodes.select("key"), "key", "left_anti").isEmpty():
        raise ValueError("no such parent")
    return nodes.unionByName(made)


def rename_collection(nodes: DataFrame, key, name: str) -> DataFrame:
    """`nodes` (key, parent, name and more) with one renamed; blank and taken names are errors."""
    if not name.strip():
        raise ValueError("a collection has a name")
    own = nodes.where(F.col("key") == F.lit(key)).select("parent").limit(1).collect()
    if not own:
        raise ValueError(f"no such collection: {key}")
    if not nodes.where(F.col("parent").eqNullSafe(F.lit(own[0]["parent"])) & (F.col("name") == name) & (F.col("key") != F.lit(key))).limit(1).isEmpty():
        raise ValueError(f"there is a collection named {name} already")
    return rewrite(nodes, F.col("key") == F.lit(key), name=name)


def below(nodes: DataFrame, keys: list) -> DataFrame:
    """(key) of the nodes with the given keys and of all below them, whatever their depth.

    Each round lets every marked node mark those whose pointer leads to it, and doubles all pointers.
    """
    held = cut(nodes.select("key", F.col("parent").alias("up"), F.coalesce(F.col("key").isin(keys), F.lit(False)).alias("hit")))
    for _ in range(held.count().bit_length() + 1):
        above = held.select(F.col("key").alias("up"), F.col("up").alias("u"), F.col("hit").alias("h"))
        held = cut(held.join(above, "up", "left").select("key", F.col("u").alias("up"), (F.col("hit") | F.coalesce("h", F.lit(False))).alias("hit")))
        if held.where("up IS NOT NULL").isEmpty():
            break
    return held.where("hit").select("key")


def delete_collections(nodes: DataFrame, samples: DataFrame, keys: list, collection: str = "collection") -> tuple[DataFrame, DataFrame]:
    """(nodes, samples) without the given collections, all below them and their samples."""
    gone = below(nodes, keys)
    return nodes.join(gone, "key", "left_anti"), samples.join(gone.withColumnRenamed("key", collection), collection, "left_anti")


def rename_tag(tags: DataFrame, old: str, new: str, name: str = "name") -> DataFrame:
    """`tags` with one renamed; links hold its id, so they stay. A name that another tag has is an error."""
    if old != new and not tags.where(F.col(name) == new).limit(1).isEmpty():
        raise ValueError(f"there is a tag named {new} already")
    return rewrite(tags, F.col(name) == old, **{name: new})


def delete_tag(tags: DataFrame, links: DataFrame, gone: str, tag: str = "tag", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(tags, links) without a tag and its links."""
    dead = tags.where(F.col(name) == gone).select(tag)
    return tags.where(~F.col(name).eqNullSafe(F.lit(gone))), links.join(dead, tag, "left_anti")


def get_or_create(dimension: DataFrame, wanted: DataFrame, name: str, key: str) -> DataFrame:
    """A dimension with a row for every wanted name: those it has keep their key, new ones get keys after the largest.

    Both sides are small dimensions; new names are numbered in alphabetical order.
    """
    from pyspark.sql import Window

    new = wanted.select(name).where(F.col(name).isNotNull()).distinct().join(dimension, name, "left_anti")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(-1)).alias("__t"))
    numbered = new.withColumn("__n", F.row_number().over(Window.orderBy(name))).join(F.broadcast(top))  # one row
    return dimension.select(key, name).unionByName(numbered.select((F.col("__t") + F.col("__n")).cast(dimension.schema[key].dataType).alias(key), name))


def relabel(annotations: DataFrame, dimension: DataFrame, changes: DataFrame, key: str, label: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, dimension) after changes (key, name): each named annotation gets that label, made if it is new."""
    grown = get_or_create(dimension, changes, name, label)
    asked = changes.join(grown, name).select(F.col(key).alias("__k"), F.col(label).alias("__l"))
    joined = annotations.join(asked, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(label, F.coalesce("__l", label)).select(*annotations.columns), grown


def set_span(rows: DataFrame, test: Column, start: str, end: str, low, high) -> DataFrame:
    """Both ends of a time span replaced together where the test holds; rows without a span keep none."""
    if low is None or high is None or low > high:
        raise ValueError("a span has both ends, in order")
    return rewrite(rows, test & F.col(start).isNotNull() & F.col(end).isNotNull(), **{start: low, end: high})


def set_box(rows: DataFrame, test: Column, kinds: list, box: dict) -> DataFrame:
    """The box of annotations of the given kinds replaced where the test holds; no field is an error."""
    if not box:
        raise ValueError("nothing to change")
    return rewrite(rows, test & F.col("kind").isin(kinds), **box)


def put_captions(captions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Captions after changes: those of a known key are replaced, others added, those with a null text deleted; blank texts fail."""
    blank = F.col("text").isNotNull() & (F.trim("text") == "")
    checked = changes.withColumn("text", F.when(blank, F.raise_error(F.lit("a caption has a text"))).otherwise(F.col("text")))
    return captions.join(changes.select(key), key, "left_anti").unionByName(checked.where(F.col("text").isNotNull()).select(*captions.columns))


def attach_tracks(annotations: DataFrame, tracks: DataFrame, links: DataFrame, key: str, track: str) -> DataFrame:
    """`annotations` with their track set through links (key, track); a track that is not there fails."""
    known = links.join(tracks.select(F.col(track).alias("__t")), F.col(track) == F.col("__t"), "left")
    value = F.when(F.col("__t").isNull(), F.raise_error(F.concat(F.lit("no such track: "), F.col(track).cast("string"))).cast(tracks.schema[track].dataType)).otherwise(F.col("__t"))
    asked = known.select(F.col(key).alias("__k"), value.alias("__v"))
    joined = annotations.join(asked, F.col(key) == F.col("__k"), "left")
    had = F.col(track) if track in annotations.columns else F.lit(None)
    return joined.withColumn(track, F.coalesce("__v", had)).drop("__k", "__v")


def attach(samples: DataFrame, annotations: DataFrame, key: str, path: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations with their sample, coverage, unknown paths) of annotations that name samples by path.

    A row of coverage (source, sample) says that the source looked at a sample, boxes or none: a path
    with a null label is such a look without a box. annotations: path, label and more.
    """
    known = annotations.join(samples.select(F.col(path).alias("__p"), F.col(key).alias("sample")), F.col(path) == F.col("__p"), "left").drop("__p")
    found = known.where(F.col("sample").isNotNull())
    covered = found.select(F.lit(source).alias("source"), "sample").distinct()
    return found.where(F.col("label").isNotNull()), covered, known.where(F.col("sample").isNull()).select(path).distinct()


def delete_scope(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]], root: str, test: Column) -> dict[str, DataFrame]:
    """The tables without the root rows that the test holds for, and without all that hangs on them.

    edges: (child table, its column, parent table, its key), parents before children. The keys that go
    are found downwards; each table is rewritten by one anti-join per edge into it.
    """
    gone = {root: tables[root].where(F.coalesce(test, F.lit(False)))}
    for child, column, parent, key in edges:
        if parent not in gone:
            continue
        dead = tables[child].join(gone[parent].select(F.col(key).alias(column)), column, "left_semi")
        gone[child] = gone[child].unionByName(dead).distinct() if child in gone else dead
    out = dict(tables)
    out[root] = tables[root].where(~F.coalesce(test, F.lit(False)))
    for child, column, parent, key in edges:
        if parent in gone:
            out[child] = out[child].join(gone[parent].select(F.col(key).alias(column)), column, "left_anti")
    return out


def deep_copy(tables: dict[str, DataFrame], keys: dict[str, str], edges: list[tuple[str, str, str]], salt: str) -> dict[str, DataFrame]:
    """Copies of whole tables with new keys: every key column and every reference to one is replaced.

    keys: key column by table; edges: (table, column, referenced table). A reference without a copy fails.
    """
    maps = {t: new_ids(tables[t], k, f"{salt}:{t}") for t, k in keys.items()}
    out = {}
    for t, rows in tables.items():
        made = remap(rows, maps[t], keys[t]) if t in keys else rows
        for child, column, parent in edges:
            if child == t:
                made = remap(made, maps[parent], column, optional=False)
        out[t] = made
    return out


def copy_name(name: Column, root: str, new: str) -> Column:
    """The first occurrence of the root's name replaced by the copy's."""
    at = F.instr(name, root)
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.lit(new), F.substring(name, at + len(root), F.length(name)))).otherwise(name)


def put_default(defaults: DataFrame, collection, space) -> DataFrame:
    """A collection's default embedding space set, or removed with None."""
    rest = defaults.where(F.col("collection") != F.lit(collection))
    return rest if space is None else rest.unionByName(defaults.sparkSession.createDataFrame([(collection, space)], defaults.schema))


def add_images(wanted: DataFrame, files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, outcomes) of adding the files at the `wanted` paths to those `known`.

    wanted and known: path; files: path, width, height of what is there (see `readers.read_images`), null
    for what is no whole image. images: path, file_name, width, height of the new ones, each once. outcomes:
    (path, outcome, n), n the number of times that a path was wanted with that outcome: ALREADY_PRESENT
    for known paths and for repeats of one that was added, MISSING, BROKEN, ADDED. A null path is missing.
    """
    asked = wanted.groupBy("path").agg(F.count("*").alias("n"))
    there = files.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.lit(True).alias("there"))
    seen = known.select("path").distinct().withColumn("seen", F.lit(True))
    joined = asked.join(there, "path", "left").join(seen, "path", "left")
    one = lambda outcome, n: F.struct(F.lit(outcome).alias("outcome"), n.alias("n"))
    again = F.when(F.col("n") > 1, F.array(one("ALREADY_PRESENT", F.col("n") - 1)))
    fresh = F.concat(F.array(one("ADDED", F.lit(1).cast("long"))), F.coalesce(again, F.array().cast("array<struct<outcome:string,n:bigint>>")))
    found = F.when(F.col("seen"), F.array(one("ALREADY_PRESENT", F.col("n")))).when(F.col("there").isNull(), F.array(one("MISSING", F.col("n")))).when(F.col("width").isNull(), F.array(one("BROKEN", F.col("n")))).otherwise(fresh)
    told = joined.withColumn("o", F.explode(found)).select("path", "width", "height", "o.outcome", "o.n")
    images = told.where("outcome = 'ADDED'").select("path", F.substring_index("path", "/", -1).alias("file_name"), "width", "height")
    return images, told.select("path", "outcome", "n")


def outcomes(files: DataFrame, known: DataFrame, path: str, readable: Column, exists: Column) -> DataFrame:
    """`files` with outcome: ALREADY_PRESENT, MISSING, BROKEN or ADDED; a path met twice is added once."""
    from pyspark.sql import Window

    seen = known.select(F.col(path).alias("__k")).distinct()
    again = F.row_number().over(Window.partitionBy(path).orderBy(path)) > 1
    joined = files.withColumn("__a", again).join(seen, F.col(path) == F.col("__k"), "left")
    present = F.col("__k").isNotNull() | F.col("__a")
    return joined.withColumn("outcome", F.when(present, "ALREADY_PRESENT").when(~exists, "MISSING").when(~readable, "BROKEN").otherwise("ADDED")).drop("__a", "__k")


def outcome_report(found: DataFrame) -> DataFrame:
    """(outcome, n) of rows with an outcome, each counted once or as often as its n says; fails where files were given and every one was missing or broken."""
    counts = found.groupBy("outcome").agg((F.sum("n") if "n" in found.columns else F.count("*")).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("outcome").isin("MISSING", "BROKEN"), F.col("n")).otherwise(0)).alias("bad"))
    n = F.when(F.col("t") == F.col("bad"), F.raise_error(F.lit("no file could be read")).cast("long")).otherwise(F.col("n"))
    return counts.join(F.broadcast(total)).select("outcome", n.alias("n"))  # total: one row
