"""Centroid clustering over zone maps along a Hilbert curve.

Vectors are whole numbers. Each gets its place on a Hilbert curve through a grid of ``2**BITS`` cells a side between the
least and the largest value of every component. Vectors are range partitioned and sorted by that place, and every
``BLOCK`` of them become one stored row: ids, vectors, and the box of the least and largest value per component.

A round reads the blocks once. From a block's box and a centroid follow the least and the most distance that any vector
of the block can have to it. A centroid whose least distance is above the smallest most distance is nearest to no vector of
the block; the others are its candidates, and each vector is compared with them in whole numbers. So the result is that of
comparing all centroids, ties included (the smaller number wins). A task gives out one sum per cluster, and sums are added
as decimals, so they do not depend on how the vectors are spread.

The driver holds the centroids and the grid's borders (components times 16, and times two); both are of fixed size.
A row number is the last key of the range partitioning, so equal vectors spread over partitions like any others.

Nulls: vectors that are null, have not the wanted number of components, or hold a null or a value that is not finite are
left out. A null id is carried, and comes last among the ids that may start a centroid. Ties between equal ids go by the
vector. Repeated rows count each. With fewer vectors than centroids there are as many centroids as vectors. An empty table
gives an empty result. Components beyond ``LARGEST`` in size would not leave room for a distance in 64 bits and stop the job with
a message. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.session import materialize

BITS = 4  # of a component in the grid
BLOCK = 256  # vectors
LARGEST = 1 << 27  # of a component; 64 squared differences stay below 2**62
FLOATS = 1 << 20  # components below this can be multiplied as doubles without rounding


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column of ``size`` components a row as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as whole numbers."""
    scaled = np.floor(scale * values.astype(np.float64))
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}")
    return scaled.astype(np.int64)


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells, as rows of bytes that sort like it (Skilling's axes-to-transpose method)."""
    axes = cells.astype(np.int64).T.copy()  # one row per component, so each step works on contiguous values
    first, last = axes[0], axes[-1]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            high = (axis >> bit) & 1
            # Where the bit is set the lower bits of the first component turn over, elsewhere they are exchanged.
            swap = np.where(high, 0, (first ^ axis) & below)
            first ^= np.where(high, below, swap)
            axis ^= swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    turn = np.zeros_like(last)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((last >> bit) & 1, (1 << bit) - 1, 0)
    axes ^= turn
    shifts = np.arange(bits - 1, -1, -1)
    digits = (axes.T[:, None, :] >> shifts[None, :, None]) & 1
    return np.packbits(digits.reshape(len(digits), -1).astype(np.uint8), axis=1)


def grid(values: np.ndarray, lows: np.ndarray, highs: np.ndarray, bits: int) -> np.ndarray:
    """The grid cell of every component between its least and largest value."""
    spread = np.maximum(highs - lows + 1, 1)
    return ((values - lows) << bits) // spread


def zone_maps(vectors: DataFrame, size: int, scale: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From rows (id, vector) of usable vectors: the stored rows (id, body) of whole numbers, and the stored blocks.

    A block has ids, vectors (32-bit numbers, row by row), and its box.
    """

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                found = whole(matrix(batch.column(0), size), scale)
                low = found.min(0) if low is None else np.minimum(low, found.min(0))
                high = found.max(0) if high is None else np.maximum(high, found.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(low), pa.array(high)], ["at", "low", "high"])

    box = vectors.select("vector").mapInArrow(borders, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = sorted(tuple(row) for row in box.collect())  # one row per component
    lows, highs = (np.array([row[k] for row in ends], np.int64) for k in (1, 2))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = whole(matrix(batch.column(1), size), scale)
            places = hilbert_places(grid(found, lows, highs, BITS), BITS)
            bodies = [row.tobytes() for row in found.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in places], pa.binary()), pa.array(bodies, pa.binary())], ["id", "place", "body"])

    points = materialize(vectors.mapInArrow(placed, "id long, place binary, body binary").withColumn("row", F.monotonically_increasing_id()), "hilbert-points")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            bodies += batch.column(1).to_pylist()
            while len(ids) >= block:
                yield packed(ids[:block], bodies[:block])
                ids, bodies = ids[block:], bodies[block:]
        if ids:
            yield packed(ids, bodies)

    def packed(ids: list[int | None], bodies: list[bytes]) -> pa.RecordBatch:
        joined = b"".join(bodies)
        found = np.frombuffer(joined, "<i4").reshape(-1, size)
        arrays = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in (joined, found.min(0).tobytes(), found.max(0).tobytes()))]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "vectors", "low", "high"])

    ordered = points.repartitionByRange("place", "row").sortWithinPartitions("place", "row").select("id", "body")
    return points, materialize(ordered.mapInArrow(blocks, "ids array<long>, vectors binary, low binary, high binary"), "hilbert-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, ascending."""
    under, over = low[None, :] - centroids, centroids - high[None, :]
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(np.abs(under), np.abs(over))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector of a block (the smaller of equals), and the squared distance."""
    tried = candidates(low, high, centroids)
    few = centroids[tried]
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(few).max()) < FLOATS:
        v, c = vectors.astype(np.float64), few.astype(np.float64)
        distances = ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(1) for c in few], axis=1)
    best = distances.argmin(1)
    return tried[best], distances[np.arange(len(best)), best]


def opened(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, low, high) of every block of a batch."""
    ids, vectors, lows, highs = (batch.column(batch.schema.get_field_index(name)) for name in ("ids", "vectors", "low", "high"))
    for k in range(batch.num_rows):
        low, high = (np.frombuffer(column[k].as_py(), "<i4").astype(np.int64) for column in (lows, highs))
        yield ids[k].values, np.frombuffer(vectors[k].as_py(), "<i4").astype(np.int64).reshape(-1, size), low, high


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; those without vectors stay."""
    count, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for _, vectors, low, high in opened(batch, size):
                chosen, _ = nearest(vectors, low, high, centroids)
                rows += np.bincount(chosen, minlength=count)
                for c in np.unique(chosen):
                    totals[c] += vectors[chosen == c].sum(0)
        used = np.flatnonzero(rows)
        arrays = [pa.array(used, pa.int32()), pa.array(rows[used]), pa.array(totals[used].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "totals"])

    each = blocks.mapInArrow(sums, "cluster int, n long, totals array<long>").select("cluster", "n", F.posexplode("totals").alias("at", "total"))
    added = each.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    result = centroids.copy()
    for row in added.collect():  # centroids times components
        result[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return result


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector of the blocks."""
    size = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, low, high in opened(batch, size):
                chosen, distances = nearest(vectors, low, high, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chosen.astype(np.int32)), pa.array(distances)], ["id", "cluster", "distance"])

    return blocks.mapInArrow(assign, "id long, cluster int, distance long")


def clusters(vectors: DataFrame, id_column: str, column: str, count: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """Per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    values = F.col(column).cast("array<double>")
    usable_rows = vectors.where(usable(values, size)).select(F.col(id_column).cast("long").alias("id"), values.alias("vector"))
    points, blocks = zone_maps(usable_rows, size, scale, block)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = points.select(hashed.alias("hash"), "body").orderBy(F.asc_nulls_last("hash"), "body").limit(count).collect()
    centroids = np.array([np.frombuffer(row["body"], "<i4") for row in starts], np.int64).reshape(-1, size)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(blocks, centroids)
        done = materialize(assigned(blocks, centroids), "hilbert-clusters")
    else:
        done = blocks.select(F.explode("ids").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))  # no rows
    parts = {row["cluster"]: int(row["inertia"]) for row in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    inertia = [parts.get(c, 0) for c in range(max(1, len(centroids)))]
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids] or [""]

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    return done.select(
        F.col("id").alias(id_column),
        "cluster",
        "distance",
        by_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        by_cluster(digests).alias("centroid_sha256"),
    )
