"""Operator 5: near duplicates among embeddings by int8 tile products.

Equal vectors of a label are one class. The classes of a label are dealt at random into tiles of
about TILE vectors, and every two tiles of a label meet in one task. There the unit vectors are
quantised to int8; the product of the quantised tiles and each vector's quantisation error bound the
cosine from above, and only pairs whose bound reaches the threshold are computed again in double
precision. A task returns counts and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.components import components
from maskloom.llm.shared import saved

THRESHOLD = 0.93
#: Vectors of a tile on average, and rows of a tile that are multiplied at a time.
TILE, ROWS = 2048, 256
#: Covers the rounding of the single-precision scaling of exact integer products.
SLACK = 1e-5
#: Columns that are summed at a time: 127 * 127 * COLUMNS is below 2**24, so single precision is exact.
COLUMNS = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as (int8 rows, scale, norm of the error): x = scale * q + e, |e| <= error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - scale[:, None] * q, axis=1)
    return q, scale, error * (1 + 1e-9) + 1e-12


def int_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of int8 rows with int8 rows. Multiplied as single-precision numbers, by as many columns as give
    exact integers, and summed up in double precision."""
    blocks = [slice(k, k + COLUMNS) for k in range(0, x.shape[1], COLUMNS)]
    parts = (x[:, c].astype(np.float32) @ y[:, c].astype(np.float32).T for c in blocks)
    return next(parts) if len(blocks) == 1 else sum(p.astype(np.float64) for p in parts)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, a block of rows at a time; i < j only if the
    tiles are the same. x and y are unit rows in double precision."""
    (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
    worst = ey.max()
    for k in range(0, len(x), ROWS):
        rows = slice(k, min(k + ROWS, len(x)))
        product = int_products(qx[rows], qy)
        product *= sx[rows, None].astype(product.dtype)
        product *= sy[None, :].astype(product.dtype)
        least = threshold - SLACK - ex[rows] - (1 + ex[rows]) * worst
        i, j = np.nonzero(product >= least[:, None])
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        if len(i) <= 20_000:
            exact = np.einsum("ij,ij->i", x[i], y[j])
        else:
            exact = (x[rows] @ y.T)[i - k, j]
        good = exact >= threshold
        yield i[good], j[good]


def forest(n: int, blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links (i, smallest index of i's component) that connect what the index pairs connect."""
    label = np.arange(n)
    if blocks:
        a, b = (np.concatenate(x) for x in zip(*blocks, strict=True))
        while True:
            least = np.minimum(label[a], label[b])
            following = label.copy()
            np.minimum.at(following, a, least)
            np.minimum.at(following, b, least)
            following = following[following]
            if (following == label).all():
                break
            label = following
    return [(i, int(r)) for i, r in enumerate(label.tolist()) if r != i]


_OUT = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _members(row: pa.StructScalar | pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls = row.field("cls").to_numpy(zero_copy_only=False)
    n = row.field("n").to_numpy(zero_copy_only=False)
    flat = row.field("embedding")
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cls), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return cls, n, x / np.linalg.norm(x, axis=1, keepdims=True)


def _pair_task(threshold: float):
    def task(table: pa.Table) -> pa.Table:
        """One or two tiles; counts of linked vectors by class, and links between classes."""
        tiles = [_members(chunk.flatten()) for chunk in (table["members"].slice(k, 1).combine_chunks() for k in range(table.num_rows))]
        (ca, na, x), (cb, nb, y) = tiles[0], tiles[-1]
        same = len(tiles) == 1
        ids, weights = (ca, na) if same else (np.concatenate([ca, cb]), np.concatenate([na, nb]))
        shift = 0 if same else len(ca)
        links, blocks = np.zeros(len(ids), np.int64), []
        for i, j in tile_links(x, y, threshold, same):
            j = j + shift
            np.add.at(links, i, weights[j])
            np.add.at(links, j, weights[i])
            blocks.append((i, j))
        some = np.flatnonzero(links)
        pairs = forest(len(ids), blocks)
        a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        return pa.table(
            {
                "cls": np.concatenate([ids[some], ids[a]]).astype(np.int64),
                "links": np.concatenate([links[some], np.zeros(len(a), np.int64)]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b].astype(np.int64))]),
            },
            schema=_OUT,
        )

    return task


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors(vec_id, embedding, label).

    Vectors that are null, empty or zero or hold null, NaN or infinite parts, a null label or a null vec_id
    link with nothing (component_id is then vec_id). Vectors of unlike length don't link. Rows with equal
    vec_id are vectors of their own, each with its own links. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    parts = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & parts.isNotNull() & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(parts, lambda v: v != 0)
    usable = rows.filter(F.coalesce(sound, F.lit(False)))
    classes = saved(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    keys = ["label", "size"]
    sized = classes.withColumn("size", F.size("embedding"))
    tiles = sized.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = sized.join(tiles, keys).withColumn("tile", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy(*keys, "tiles", "tile").agg(F.collect_list(F.struct("cls", "n", "embedding")).alias("members"))
    met = packed.select(*keys, "members", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("partner"))
    # a label's tile without members has no row; then a task has one tile, which meets itself elsewhere
    met = met.select(*keys, "members", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "tile")
    task = _pair_task(threshold)

    def run(table: pa.Table) -> pa.Table:
        alone = table.num_rows == 1 and table["low"][0].as_py() != table["high"][0].as_py()
        return _OUT.empty_table() if alone else task(table)

    found = saved(met.groupBy(*keys, "low", "high").applyInArrow(run, "cls long, links long, other long"), "vector-links")
    counts = found.filter("other IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other IS NOT NULL"), "cls", "other")
    least = joined.join(classes.select(F.col("cls").alias("node"), "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("least"))
    joined = joined.join(least, "component").select(F.col("node").alias("cls"), "least")
    by_class = (
        classes.join(counts, "cls", "left")
        .join(joined, "cls", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    )
    linked = usable.join(by_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    single = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
