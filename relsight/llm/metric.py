"""Exact metric range join of embeddings by pivots.

Unit vectors at cosine c are sqrt(2 - 2c) apart. Every vector's home is the
cell of its nearest pivot. It is replicated to each later cell q with
d(x, q) <= d(x, home) + 2 eps, which the triangle inequality shows to be all
that can hold a partner; so each pair meets in exactly one cell. Cells join
independently, in tiles of a bounded number of rows; a tile gives counts and
a spanning forest of its links, never all pairs. Equal vectors are one class.

Defined cases: a vector that is null, empty, zero, or has null or non-finite
components, or whose label is null, links with nothing; vectors of different
lengths don't link; repeated rows are vectors of their own; a null vec_id
counts as a link of others but names no component; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsight.llm.arrays import forest
from relsight.llm.shared import components, drop_written, written

#: Vectors that a cell has on average, and rows of a tile.
CELL, TILE = 1024, 2048
#: Pivots grow with the size until they are these bytes, which every task can hold; beyond, cells grow.
PIVOT_BYTES = 64 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_space(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row indices of each (label, dimension) of a batch."""
    groups = defaultdict(list)
    for i, space in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
        groups[space].append(i)
    for space, rows in groups.items():
        yield space, np.array(rows)


def metric_links(vectors: DataFrame, min_cosine: float = 0.93, cell: int = CELL, pivot_bytes: int = PIVOT_BYTES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of all rows of (vec_id, embedding, label)."""
    # The slack covers the rounding of a distance near 0, the root of that of a product.
    eps = float(np.sqrt(2 - 2 * min_cosine)) + 1e-6
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # Only a class of rows without ids has no rep; its number is below all ids in use.
    named = classes.select(F.coalesce("rep", F.xxhash64("label", "embedding").bitwiseOR(F.lit(-(1 << 63)))).alias("rep"), "label", F.size("embedding").alias("dim"), "n", "embedding")
    named = written(named, "vectors")
    total, widest = named.agg(F.count("*"), F.max("dim")).first()
    # Enough for cells of the wanted size, but no more than balances the work in cells with that of finding them.
    wanted = max(1, min(-(-total // cell), 8 * isqrt(total), pivot_bytes // (8 * widest))) if total else 0
    chosen = named.select("label", "dim", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(wanted).toArrow() if wanted else None
    pivots: dict[tuple, np.ndarray] = {}
    if chosen is not None:
        for batch in chosen.to_batches():
            for space, at in by_space(batch):
                found = matrix(batch.column("embedding").take(pa.array(at)))
                pivots[space] = np.vstack([pivots[space], found]) if space in pivots else found

    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, _), at in by_space(batch):
                part = batch.take(pa.array(at))
                space = (part.column("label")[0].as_py(), part.column("dim")[0].as_py())
                p = shared.value.get(space)
                if p is None:
                    take, cells, guest = np.arange(len(at)), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
                else:
                    d = np.sqrt(np.maximum(0, 2 - 2 * matrix(part.column("embedding")) @ p.T))
                    home = d.argmin(axis=1)
                    near = (d <= d.min(axis=1)[:, None] + 2 * eps) & (np.arange(len(p))[None, :] > home[:, None])
                    guests, to = np.nonzero(near)
                    take = np.concatenate([np.arange(len(at)), guests])
                    cells = np.concatenate([home, to]).astype(np.int32)
                    guest = np.arange(len(take)) >= len(at)
                out = part.take(pa.array(take))
                yield pa.record_batch([pa.array(cells), pa.array(guest), *out.columns], names=["cell", "guest", *out.schema.names])

    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = matrix(table["embedding"].chunk(0))
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        side, guest = table["side"].to_numpy(), np.asarray(table["guest"])
        links = np.zeros(len(rep), np.int64)
        heads, tails = [], []
        left = np.flatnonzero(side != 1)
        right = left if (side == 2).all() else np.flatnonzero(side == 1)
        for a in range(0, len(left), 1024):
            i = left[a : a + 1024]
            hit = x[i] @ x[right].T >= min_cosine
            hit &= ~(guest[i][:, None] & guest[right][None, :])
            if right is left:
                hit[np.arange(len(i)), np.arange(a, a + len(i))] = False
                links[i] += hit @ n[right]
            else:
                links[i] += hit @ n[right]
                links[right] += n[i] @ hit
            u, v = np.nonzero(hit)
            heads.append(i[u])
            tails.append(right[v])
        root = forest(len(rep), np.concatenate(heads), np.concatenate(tails)) if heads else np.arange(len(rep))
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, root, rep)
        return pa.table({"rep": rep, "links": links, "low": low[root]}).filter(pa.array(links > 0))

    cells = named.mapInArrow(dealt, "cell int, guest boolean, rep long, label " + named.schema["label"].dataType.simpleString() + ", dim int, n long, embedding " + named.schema["embedding"].dataType.simpleString())
    cells = written(cells, "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = cells.join(sizes, ["label", "dim", "cell"]).withColumn("own", own).withColumn("other", other)
    block = [F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t")]
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    tiled = tiled.select("label", "dim", "cell", *block, side, "guest", "rep", "n", "embedding")
    found = written(tiled.groupBy("label", "dim", "cell", "s", "t").applyInArrow(linked, "rep long, links long, low long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> low"), "rep", "low")
    drop_written(cells)
    result = named.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    result = result.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    one = rows.where(good).join(result, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
