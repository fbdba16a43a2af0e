"""Run-length masks as array columns: row by row, the first run of zeros, runs adding up to width times height."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels of polygons' masks that a task holds at once.
CELLS = 1 << 22


def decode(runs: Column) -> Column:
    """Array of the pixels, 0 or 1."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))


def encode(pixels: Column) -> Column:
    """Array of the runs of an array of pixels (0 or 1); no pixels give no runs."""

    @F.arrow_udf("array<int>")
    def runs(rows: pa.Array) -> pa.Array:
        return _encoded(rows)

    return runs(pixels)


def _run_lists(of: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The runs of lists of pixels that change at the places `at` of the lists `of`, in order; lists without pixels have none."""
    some = sizes > 0
    count = np.bincount(of, minlength=len(sizes)) + some
    offsets = np.r_[0, np.cumsum(count)]
    stop = np.empty(offsets[-1], np.int64)
    stop[np.arange(len(at)) + np.cumsum(some)[of] - 1] = at
    stop[offsets[1:][some] - 1] = sizes[some]
    start = np.r_[0, stop[:-1]][: len(stop)]
    start[offsets[:-1][some]] = 0
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(stop - start, pa.int64()))


def _encoded(rows: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    first = np.r_[0, np.cumsum(sizes)[:-1]][: len(sizes)]
    changed = np.empty(len(flat), bool)
    changed[1:] = flat[1:] != flat[:-1]
    heads = first[sizes > 0]
    changed[heads] = flat[heads] != 0  # after an imagined 0: a mask that begins with 1 has an empty first run
    places = np.flatnonzero(changed)
    of = np.searchsorted(np.cumsum(sizes), places, side="right")
    return _run_lists(of, places - first[of], sizes).cast(pa.list_(pa.int32()))


def spans(runs: Column) -> Column:
    """Array of the set runs as structs of start and stop, in pixels."""
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), (1 - s["on"]).alias("on"), F.when((s["on"] == 1) & (n > 0), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + n).alias("stop"))))).otherwise(s["out"]).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("on"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))
    return F.aggregate(F.transform(runs, lambda n: n.cast("long")), start, step, lambda s: s["out"])


def area(runs: Column) -> Column:
    """Number of set pixels."""
    return F.aggregate(F.transform(runs, lambda n, i: F.when(i % 2 == 1, n.cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n)


def bounding_box(runs: Column, width: Column) -> Column:
    """Struct of x, y, width, height of the set pixels; all four are 0 for an empty mask.

    A span within one row bounds its columns itself, one over a row's end covers a whole row.
    """
    found = spans(runs)
    row = lambda at: F.floor(at / width)
    lows = F.transform(found, lambda s: F.when(row(s["start"]) == row(s["stop"] - 1), s["start"] % width).otherwise(0))
    highs = F.transform(found, lambda s: F.when(row(s["start"]) == row(s["stop"] - 1), (s["stop"] - 1) % width).otherwise(width - 1))
    top, bottom = row(F.array_min(F.transform(found, lambda s: s["start"]))), row(F.array_max(F.transform(found, lambda s: s["stop"])) - 1)
    some = F.size(found) > 0
    part = lambda v, name: F.when(some, v).otherwise(0).cast("long").alias(name)
    return F.struct(part(F.array_min(lows), "x"), part(top, "y"), part(F.array_max(highs) - F.array_min(lows) + 1, "width"), part(bottom - top + 1, "height"))


def box_runs(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Runs of a mask that is a box, cut to the image; the last run of zeros is left out if empty."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    wide, tall = F.greatest(x1 - x0, F.lit(0)), F.greatest(y1 - y0, F.lit(0))
    between = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(tall, F.lit(1)).cast("int")), lambda i: F.when(i < tall, F.array(wide, width - wide)).otherwise(F.array(wide))))
    lead, tail = y0 * width + x0, (height - y1) * width + (width - x1)
    full = F.concat(F.array(lead), between, F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<bigint>")))
    cast = lambda a: F.transform(a, lambda n: n.cast("long"))
    return F.when((wide > 0) & (tall > 0), cast(full)).otherwise(F.array((width * height).cast("long")))


def column_runs(runs: Column, width: Column, height: Column) -> Column:
    """The same mask's runs column by column, as other formats have them.

    Turning needs the pixels, so each mask is one NumPy bitmap while its row is at work.
    """

    @F.pandas_udf("array<bigint>")
    def turn(rs: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for r, w, h in zip(rs, ws, hs, strict=True):
            bits = np.repeat(np.arange(len(r)) % 2, np.asarray(r, np.int64)).astype(np.int8).reshape(int(h), int(w)).T.ravel()
            edges = np.flatnonzero(np.diff(np.concatenate(([0], bits))))
            out.append(np.diff(np.concatenate(([0], edges, [len(bits)]))).tolist())
        return pd.Series(out)

    return turn(runs, width, height)


def polygon_runs(polygons: Column, width: Column, height: Column) -> Column:
    """Runs of the union of polygons, each a flat array x, y, x, y ... of at least three corners (fewer: nothing).

    A pixel is set if its centre lies inside: in each row the edges' crossings with the centre line switch
    the fill on and off, cut to the image. Masks of one size are filled together, up to CELLS pixels (or one mask) at once.
    A null array of polygons gives null.
    """

    @F.arrow_udf("array<bigint>")
    def fill(ps: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        sizes = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ws, hs)], axis=1).reshape(-1, 2)
        shapes, kind = np.unique(sizes, axis=0, return_inverse=True)
        made, order = [pa.array([], pa.list_(pa.int64()))], [np.empty(0, np.int64)]
        for s, (w, h) in enumerate(shapes.tolist()):
            same = np.flatnonzero(kind.reshape(-1) == s)
            for some in np.array_split(same, -(-len(same) // max(1, CELLS // max(1, w * h)))):
                made.append(_filled(ps.take(pa.array(some)), w, h))
                order.append(some)
        found = pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order))))
        return pc.if_else(ps.is_valid(), found, pa.scalar(None, found.type))

    return fill(polygons, width, height)


def _filled(masks: pa.Array, width: int, height: int) -> pa.ListArray:
    """Runs of masks of one size, each of a list of polygons."""
    n, size = len(masks), width * height
    if not size:
        return pa.array([[0]] * n, pa.list_(pa.int64()))
    polygons = masks.flatten()
    held = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = polygons.flatten().to_numpy(zero_copy_only=False)
    corners = np.where(sizes < 6, 0, sizes // 2)
    of = np.repeat(np.arange(len(sizes)), corners)
    corner = _places(corners)
    base = (np.cumsum(sizes) - sizes)[of]
    follows = np.where(corner + 1 == corners[of], 0, corner + 1)
    x, y, to_x, to_y = flat[base + 2 * corner], flat[base + 2 * corner + 1], flat[base + 2 * follows], flat[base + 2 * follows + 1]
    # Rows whose centre line an edge crosses: the lower end counts, the upper one does not.
    top, low = (np.clip(np.ceil(e - 0.5), 0, height).astype(np.int64) for e in (np.minimum(y, to_y), np.maximum(y, to_y)))
    edge = np.repeat(np.arange(len(of)), low - top)
    row = top[edge] + _places(low - top)
    meets = x[edge] + (row + 0.5 - y[edge]) * (to_x[edge] - x[edge]) / (to_y[edge] - y[edge])
    column = np.clip(np.ceil(meets - 0.5), 0, width).astype(np.int64)
    mask, turn = np.repeat(np.arange(n), held)[of[edge]], _places(held)[of[edge]]
    at = (mask * height + row) * (width + 1) + column
    bits = np.zeros((n, height, width), np.uint8)
    order = np.argsort(turn, kind="stable")
    for part in np.split(at[order], np.flatnonzero(np.diff(turn[order])) + 1):  # a polygon of each mask at a time
        switches = np.bincount(part, minlength=n * height * (width + 1)).astype(np.uint8).reshape(n, height, width + 1)
        bits |= np.cumsum(switches, axis=2, dtype=np.uint8)[:, :, :width] & 1
    bits = bits.reshape(n, size)
    changed = bits != 0
    changed[:, 1:] = bits[:, 1:] != bits[:, :-1]
    return _run_lists(*np.nonzero(changed), np.full(n, size))


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each count."""
    counts = counts.astype(np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
