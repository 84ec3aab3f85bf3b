"""Approximate nearest neighbours by shifted space-filling curves.

Each of several orderings projects the unit vectors on a random orthonormal
frame, shifts them, and sorts them by their Hilbert key with Spark's range
partitioning. A query meets the rows whose places in an ordering lie within a
window of its own; the best of all orderings are merged by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, table

#: Projected dimensions and bits of each (48-bit keys).
DIMS, BITS = 8, 6


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates (Skilling's transposed form), as int64."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            swap = (x[0] ^ x[i]) & (q - 1)
            hit = (x[i] & q) != 0
            x[0] ^= np.where(hit, q - 1, swap)
            x[i] ^= np.where(hit, 0, swap)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> b & 1
    return key


def keys(unit: np.ndarray, ordering: int) -> np.ndarray:
    """Hilbert keys of unit vectors in one ordering; frame and shift follow from the ordering's number."""
    dim = unit.shape[1]
    rng = np.random.default_rng([ordering, dim])
    used = min(DIMS, dim)
    frame = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :used]
    # A coordinate of a random unit vector spreads about 1 / sqrt(dim); three of that fill the grid.
    at = (unit @ frame) * np.sqrt(dim) / 3 + rng.uniform(-0.15, 0.15, used)
    grid = 1 << BITS
    return hilbert(np.clip((at + 1) / 2 * grid, 0, grid - 1).astype(np.int64), BITS)


def usable(vector: Column) -> Column:
    """Neither null nor zero, no component null, infinite or not a number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keyed(vectors: DataFrame, orderings: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dim in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == dim))
                unit = _matrix(some.column(1))
                unit = unit / np.abs(unit).max(1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                for t in range(orderings):
                    n = len(unit)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim * orderings + t, np.int64)), pa.array(keys(unit, t)), some.column(0)], ["t", "key", "rep"])

    return vectors.select("rep", "v", F.size("v").cast("long").alias("dim")).mapInArrow(run, "t long, key long, rep long")


def _ranked(keyed: DataFrame) -> DataFrame:
    """(t, place, rep): places from 0 in each ordering, from the sizes of the range partitions and the places inside them."""
    # Keys are cut first: range partitioning reads its input twice. After it the order inside a partition is fixed by the sort.
    rows = cut(cut(keyed).repartitionByRange("t", "key", "rep").sortWithinPartitions("t", "key", "rep"))
    rows = rows.select("t", "rep", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
    # One row for each partition and ordering that meet: partitions + orderings at most.
    parts = rows.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    before = Window.partitionBy("t").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("t", "p", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    return rows.join(F.broadcast(parts), ["t", "p"]).select("t", (F.col("i") + F.col("shift")).alias("place"), "rep")


def _search(k: int):
    """In each cell the candidates come first; the queries then stream past them."""
    names = ["query", "rep", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, mats, ready, reps = None, [], [], None, None
        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])])).tolist()
            for at, end in zip(edges, [*edges[1:], len(cells)], strict=True) if len(cells) else ():
                if cells[at] != cell:
                    cell, ids, mats, ready = cells[at], [], [], None
                part = batch.slice(at, end - at)
                who, v = part.column(2).to_numpy(), _matrix(part.column(3))
                scale = np.abs(v).max(1, keepdims=True)
                v = v / scale
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                if sides[at] == 0:
                    ids.append(who)
                    mats.append(v)
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready, reps = np.concatenate(mats).T.copy(), np.concatenate(ids)
                for s in range(0, len(v), 256):
                    score = v[s : s + 256] @ ready
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(who[s : s + 256], top.shape[1])), pa.array(reps[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], names
                    )

    return run


def neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    orderings: int = 16,
    window: float = 0.03,
    least: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, itself left out, ties to smaller ids.

    ``queries`` tells the query rows; all rows are candidates. A window reaches
    ``window`` of all distinct vectors, ``least`` at the fewest, to either side;
    orderings are cut into blocks of that many rows, and a query meets its own
    block and those that its window touches. Vectors without clusters need a
    wide window for a recall of 0.9; on clustered vectors a small one does. Equal vectors are
    indexed and searched once, and up to k + 1 of their ids come back, which is
    all that k places can use. Vectors that are null, zero or hold null or
    non-finite components, and rows without id, take no part; vectors of
    different lengths don't meet. Rows that share an id are searched apart, and
    none is its own neighbour. An empty table gives no rows.
    """
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(usable(F.col("v")))
    copies = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks"))
    # Two different vectors of one id must not share a name: the later ones are told apart by their hash.
    twice = Window.partitionBy("rep").orderBy(F.xxhash64("v"))
    copies = copies.withColumn("nth", F.row_number().over(twice))
    copies = cut(copies.withColumn("rep", F.when(F.col("nth") == 1, F.col("rep")).otherwise(F.xxhash64("v", "rep"))).drop("nth"))
    n = copies.count()
    reach = max(least, int(np.ceil(window * n)))
    ranked = _ranked(_keyed(copies.select("rep", "v"), orderings))
    ranked = ranked.join(copies.select("rep", "v", "asks"), "rep")
    cell = lambda block: F.xxhash64("t", block)
    block = F.floor(F.col("place") / reach)
    have = ranked.select(cell(block).alias("cell"), F.lit(0).alias("side"), "rep", "v")
    spread = F.sequence(F.greatest(block - 1, F.lit(0)), block + 1)
    ask = ranked.where("asks").withColumn("block", F.explode(spread)).select(cell(F.col("block")).alias("cell"), F.lit(1).alias("side"), "rep", "v")
    cells = have.union(ask).repartition("cell").sortWithinPartitions("cell", "side")
    found = cells.mapInArrow(_search(k + 1), "query long, rep long, score double")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # The least k + 1 ids of each distinct vector; partial limits run before the shuffle.
    named = rows.join(copies.where("n > 1").select("rep", "v"), "v").select("rep", "id")
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    named = named.union(rows.join(copies.where("n = 1").select("rep", "v"), "v").select("rep", "id"))
    answers = found.join(named, "rep").select("query", "id", "score")
    asked = rows.where("asks").join(copies.where("asks").select("rep", "v"), "v").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    out = asked.join(answers, "query").where("id <> query_id")
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
