"""Clustering around centroids in whole numbers, with zone maps over blocks in Hilbert order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatimeline.session import settle, ship

SCALE = 1024
BITS = 4  # of each component in the Hilbert order
BLOCK_ROWS = 128  # vectors under one box
MAX_CENTROID_CELLS = 1 << 20  # centroids times components: the most that is sent to every task
SMALL = 1 << 26  # components below it have squared distances in 64 bits, up to 1,024 components
LONGEST = (1 << 63) - 1

BLOCKS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("rows", T.BinaryType()),
                       T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])


@dataclass
class Model:
    """Final centroids (exact whole numbers), and the inertia of each cluster and of all."""

    centroids: list[list[int]]
    inertia: list[int]


def kept_vectors(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (floor of 1,024 times each component, as longs) of the rows that count.

    Those have exactly `dims` components, none of them null, NaN or infinite, nor beyond 2^62 after scaling.
    """
    v = vectors[vector_col].cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float((1 << 62) // SCALE)), F.lit(False)) & ~F.isnan(x))
    return vectors.where((F.size(v) == dims) & fine).select(
        vectors[id_col].alias("id"), F.transform(v, lambda x: F.floor(x * float(SCALE)).cast("long")).alias("v"))


def first_centroids(kept: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of prefix and id; repeated ids come in order of their components, null ids last."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    picked = kept.withColumn("digest", digest).orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).select("v").collect()
    return [list(r.v) for r in picked]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of `cells` (0 <= cell < 2^bits) on the Hilbert curve, as bytes that sort in that order.

    Skilling's transform ("Programming the Hilbert curve", 2004) on all rows at once: undo the excess work from the highest
    bit on, then Gray-encode; the key is the transposed bits, highest first.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [((x >> b) & 1).astype(np.uint8).T for b in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes, axis=1), axis=1)]


def curve_order(kept: DataFrame, dims: int, bits: int = BITS) -> DataFrame:
    """The rows with `key`, their place on the curve. Cells span mean +- 3 deviations of each component; what lies outside
    counts as the outermost cell. The spans steer the order of rows only, never a result."""
    parts = [f(F.element_at("v", i + 1).cast("double")) for f in (F.avg, F.stddev_pop) for i in range(dims)]
    stats = kept.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
    middle = np.array([s or 0.0 for s in stats[:dims]])
    spread = np.array([s or 0.0 for s in stats[dims:]])
    spread[~np.isfinite(spread) | (spread == 0)] = 1.0
    middle[~np.isfinite(middle)] = 0.0
    schema = T.StructType([*kept.schema.fields, T.StructField("key", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                at = (values - middle) / (6 * spread) + 0.5
                cells = np.clip(np.floor(at * (1 << bits)), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary())], names=schema.names)

    return kept.mapInArrow(place, schema)


def blocks(kept: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows in Hilbert order, cut into blocks: their vectors, ids and the box of smallest and largest components.

    Rows are dealt by ranges of (key, place in the input), so copies of one vector, however many, spread over tasks.
    """
    ship(kept.sparkSession)
    placed = curve_order(kept.withColumn("place", F.monotonically_increasing_id()), dims)
    ordered = placed.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("id", "v")
    id_type = kept.schema["id"].dataType
    schema = T.StructType([*BLOCKS.fields, T.StructField("id_list", T.ArrayType(id_type))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                piece = batch.slice(start, block_rows)
                values = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.num_rows], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([values.min(axis=0).tobytes()], pa.binary()), pa.array([values.max(axis=0).tobytes()], pa.binary()), ids],
                    names=schema.names)

    return ordered.mapInArrow(cut, schema)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector in the box, ties included.

    The centroid nearest to the middle of the box is the rival: another one is out if it is further than the rival from
    every point of the box. The difference of two squared distances is linear, so its maximum over the box lies in the
    corner that each component picks for itself.
    """
    middle = low + (high - low) // 2
    rival = centroids[((centroids - middle) ** 2).sum(axis=1).argmin()]
    apart = 2 * (centroids - rival)
    most = np.maximum(low * apart, high * apart).sum(axis=1) + (rival * rival).sum() - (centroids * centroids).sum(axis=1)
    return np.flatnonzero(most >= 0)


def nearest(values: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many centroids were compared. Exact: beyond SMALL the numbers
    are Python's."""
    if max(abs(low).max(), abs(high).max(), abs(centroids).max()) >= SMALL:
        values, low, high = values.astype(object), low.astype(object), high.astype(object)
        centroids = centroids.astype(object)
    able = candidates(low, high, centroids)
    apart = [((values - centroids[c]) ** 2).sum(axis=1) for c in able]
    best, distance = np.full(len(values), able[0]), apart[0]
    for c, d in zip(able[1:], apart[1:]):
        closer = d < distance
        best, distance = np.where(closer, c, best), np.where(closer, d, distance)
    return best, distance, len(able)


def _read(batch: pa.RecordBatch, i: int, dims: int):
    values = np.frombuffer(batch.column(1)[i].as_py(), np.int64).reshape(-1, dims)
    return values, np.frombuffer(batch.column(2)[i].as_py(), np.int64), np.frombuffer(batch.column(3)[i].as_py(), np.int64)


def step(cut: DataFrame, centroids: list[list[int]], dims: int) -> tuple[list[list[int]], list[int], list[int]]:
    """Sums of components, counts and inertia per cluster, exact. Each task adds up its blocks; clusters x components rows a
    task are summed by Spark as decimals, and clusters x components numbers reach the driver."""
    k = len(centroids)
    schema = "cluster int, dim int, total decimal(38,0)"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        sums = np.zeros((k, dims + 2), object)
        for batch in batches:
            for i in range(batch.num_rows):
                values, low, high = _read(batch, i, dims)
                best, distance, _ = nearest(values, low, high, at)
                wide = values.astype(object) if distance.dtype == object else values
                for c in np.unique(best):
                    mine = best == c
                    sums[c] += np.array([*wide[mine].sum(axis=0).tolist(), int(mine.sum()), int(distance[mine].sum())], object)
        cells = [(c, d) for c in range(k) for d in range(dims + 2) if sums[c, d]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in cells], pa.int32()), pa.array([d for _, d in cells], pa.int32()),
             pa.array([Decimal(int(sums[c, d])) for c, d in cells], pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    rows = cut.select("n", "rows", "low", "high").mapInArrow(add, schema).groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()
    total = [[0] * (dims + 2) for _ in range(k)]
    for r in rows:
        total[r.cluster][r.dim] = int(r.total)
    return [t[:dims] for t in total], [t[dims] for t in total], [t[dims + 1] for t in total]


def fit(cut: DataFrame, start: list[list[int]], dims: int, rounds: int) -> Model:
    """`rounds` times: assign every vector, then put each centroid at the floor of its vectors' mean; empty ones stay."""
    at = start
    for _ in range(rounds):
        sums, counts, _ = step(cut, at, dims)
        at = [[s // n for s in sums[c]] if (n := counts[c]) else at[c] for c in range(len(at))]
    return Model(at, step(cut, at, dims)[2])


def assign(cut: DataFrame, model: Model, dims: int, id_col: str = "vec_id") -> DataFrame:
    """`id_col`, cluster, distance, cluster_inertia, inertia, centroid_sha256 and compared (centroids compared) of every vector."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids]
    whole = sum(model.inertia)
    id_type = cut.schema["id_list"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                           T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
                           T.StructField("centroid_sha256", T.StringType()), T.StructField("compared", T.IntegerType())])

    def held(n: int) -> int | None:
        return n if n <= LONGEST else None

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(model.centroids, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                best, distance, compared = nearest(*_read(batch, i, dims), at)
                best = best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4)[i].values, pa.array(best, pa.int32()), pa.array([held(int(d)) for d in distance], pa.int64()),
                     pa.array([held(model.inertia[c]) for c in best], pa.int64()), pa.array([held(whole)] * len(best), pa.int64()),
                     pa.array([digests[c] for c in best]), pa.array([compared] * len(best), pa.int32())], names=schema.names)

    return cut.select("n", "rows", "low", "high", "id_list").mapInArrow(label, schema).withColumnRenamed("id", id_col)


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, prefix: str = "3:", id_col: str = "vec_id",
                      vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest of k centroids for every vector, after `rounds` rounds of assigning and averaging in whole numbers.

    Vectors are put in Hilbert order once and cut into blocks with the smallest and largest value of each component. A round
    bounds what the distances to a block's box can differ by, compares the block's vectors only with centroids that may win,
    and adds up sums per task, so nothing is shuffled but k x dims sums a task. Boxes rule out centroids where vectors lie in
    groups; directions drawn at random in many dimensions leave all of them in, and then every vector is compared with all. The centroids are the only
    thing sent to all tasks; k x dims is checked against MAX_CENTROID_CELLS.

    Vectors with another number of components, with null, NaN or infinite ones, or with ones beyond 2^62 after scaling are
    left out. Ids may be null or repeated: each kept row comes out once. Ties go to the smaller number. A squared distance or
    an inertia beyond 64 bits is null. With fewer than k vectors all of them are centroids; an empty table gives an empty
    result. Other columns are not read, so names can't clash. Sums are exact: neither order nor retries change a result.
    """
    if k * dims > MAX_CENTROID_CELLS:
        raise ValueError(f"{k} centroids of {dims} components are more than the {MAX_CENTROID_CELLS} numbers that may be sent to every task")
    kept = kept_vectors(vectors, dims, id_col, vector_col)
    start = first_centroids(kept, k, prefix)
    if not start:
        return assign(kept.sparkSession.createDataFrame([], T.StructType([
            *BLOCKS.fields, T.StructField("id_list", T.ArrayType(kept.schema["id"].dataType))])), Model([], []), dims, id_col)
    cut = settle(blocks(kept, dims, block_rows))
    return assign(cut, fit(cut, start, dims, rounds), dims, id_col)


def sql(k: int = 8, rounds: int = 10, dims: int = 64, prefix: str = "3:", table: str = "embeddings", id_col: str = "vec_id",
        vector_col: str = "embedding") -> str:
    """The same for DuckDB: vectors and centroids with one row per component."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, {id_col} AS id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN {vector_col}] AS v
  FROM {table} WHERE len({vector_col}) = {dims}
  AND len([x FOR x IN {vector_col} IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = {dims}),
cells AS MATERIALIZED (SELECT rid, unnest(range({dims})) AS dim, unnest(v) AS x FROM kept),
seeds AS (SELECT v, row_number() OVER (ORDER BY sha256('{prefix}' || id::VARCHAR) NULLS LAST, v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS dim, unnest(v) AS y FROM seeds WHERE c < {k})"""]
    near = "SELECT rid, min((d, c)) AS best FROM (SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM cells JOIN {at} USING (dim) GROUP BY rid, c) GROUP BY rid"
    for i in range(rounds):
        steps.append(f"""
a{i} AS MATERIALIZED ({near.format(at=f"c{i}")}),
m{i} AS (SELECT best[2] AS c, dim, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN cells USING (rid) GROUP BY best[2], dim),
c{i + 1} AS MATERIALIZED (SELECT o.c, o.dim, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
  FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c AND m.dim = o.dim)""")
    steps.append(f"""
last AS MATERIALIZED ({near.format(at=f"c{rounds}")}),
named AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY dim)) AS digest FROM c{rounds} GROUP BY c)
SELECT k.id AS {id_col}, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM last JOIN kept k USING (rid) JOIN named ON named.c = best[2]""")
    return ",".join(steps)
