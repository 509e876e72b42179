"""Exact search for the vectors with the largest inner products: buckets of like length, pruned by length or coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flightlens.session import stored

TOP = 10
SHRINK = 0.9  # the shortest vector of a bucket has at least this part of the length of the longest
TILE = 4096  # vectors of a bucket that are compared at once
BLOCK_BYTES = 16 << 20  # query vectors that are sent to the tasks at once
FEW_QUERIES = 256  # queries of a tile that are multiplied at once
SEEDS = 4096  # vectors, about, from which every query gets its first threshold
STEEP = 0.8  # local cosine thresholds from here on are pruned by coordinates, lower ones by length
FOCUS = 4  # coordinates that are looked at
SLACK = 1e-9  # bounds are taken this much wider than computed, so rounding prunes nothing
SAFE = 2.0**53  # up to here floating point adds whole numbers without error


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined components; false for null ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def quantized(vectors: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) with whole components, without the vectors that take no part."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.filter(usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def by_length(vectors: DataFrame, name: str = "topk-vectors") -> DataFrame:
    """(vec_id, x, dim, bucket, spread), each row once, stored in the order of (dim, bucket, spread).

    ``bucket`` falls with the length: 0 holds the vectors of length 1 to 1 / 0.9, longer ones have negative numbers; null
    vectors of length 0 come last. ``spread``, a hash, cuts a bucket that many vectors share into ranges.
    """
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = vectors.select("vec_id", "x").groupBy("vec_id", "x").agg(F.lit(0).alias("_")).drop("_")
    rows = rows.withColumn("_squares", squares).withColumns(
        {
            "dim": F.size("x"),
            "bucket": F.when(F.col("_squares") == 0, F.lit(1 << 30)).otherwise(F.floor(F.log("_squares") / (2 * np.log(SHRINK)))).cast("int"),
            "spread": F.xxhash64("vec_id", "x"),
        }
    )
    order = ["dim", "bucket", "spread"]
    return stored(rows.drop("_squares").repartitionByRange(*order).sortWithinPartitions(*order), name)


def matrix(column) -> np.ndarray:
    """Lists of equal length as rows of a matrix of 64-bit numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors (m, d) and (n, d) as an (m, n) matrix; whole numbers of any size if need be."""
    top = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    most = top[0] * top[1] * max(1, a.shape[1])
    if most < SAFE:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


class Queries:
    """A block of queries of one dimension, with the best rows found so far: ``TOP`` scores and ids each, best first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray | None, top: int):
        self.ids, self.x, self.top = ids, x, top
        self.length = np.sqrt((x.astype(float) ** 2).sum(1))
        self.unit = x / np.where(self.length == 0, 1, self.length)[:, None]
        self.best = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()

    def offer(self, q: int, ids: np.ndarray, valid: np.ndarray, scores: np.ndarray) -> None:
        """Take rows whose score reaches the floor of query ``q``; a null key comes after all others in a tie."""
        take = np.flatnonzero((scores >= self.floor[q]) & ~(valid & (ids == self.ids[q])))
        if len(take) > self.top:
            worst = np.sort(scores[take])[-self.top]
            take = take[scores[take] >= worst]
        if not len(take):
            return
        both = self.best[q] + [(-int(scores[i]), not valid[i], int(ids[i])) for i in take]
        self.best[q] = sorted(both)[: self.top]
        if len(self.best[q]) == self.top:
            self.floor[q] = max(self.floor[q], -self.best[q][-1][0])


def search_tile(queries: Queries, ids: np.ndarray, valid: np.ndarray, x: np.ndarray) -> dict[str, int]:
    """Offer a tile of vectors of like length to all queries. Returns how many (query, vector) pairs each way verified.

    The floor of a query over its length and the longest vector's is the cosine that a vector needs at least: the local
    threshold. Over 1, the tile is skipped. If steep, the coordinates where the unit query is largest leave each vector an
    interval: with cosine t at least and query coordinate c, a unit vector has c * t +- sqrt((1 - t * t)(1 - c * c)) there.
    The tile's sorted coordinate gives the shortest such interval, the others thin it out. If not steep, vectors long
    enough for the floor are left. What is left is multiplied exactly.
    """
    length = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, valid, x, length = ids[order], valid[order], x[order], length[order]
    unit = x / np.where(length == 0, 1, length)[:, None]
    seen = {"length": 0, "coordinate": 0}
    with np.errstate(divide="ignore", invalid="ignore"):
        local = queries.floor / (queries.length * length[0])
    # a query or tile of length 0 has only products of 0: no angle, so nothing to prune by unless the floor is positive
    local = np.where(np.isnan(local), 0, local)
    open_ = np.flatnonzero(local <= 1 + SLACK)
    steep = (local[open_] >= STEEP) & (x.shape[1] > 1)
    if len(steep) and steep.any():
        lists = np.argsort(unit, axis=0, kind="stable")
        sorted_ = np.take_along_axis(unit, lists, axis=0)
        for q in open_[steep].tolist():
            t, u = min(1.0, local[q]), queries.unit[q]
            focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
            wide = np.sqrt((1 - t * t) * np.maximum(0, 1 - u[focus] ** 2)) + 1e-7
            low, high = u[focus] * t - wide, u[focus] * t + wide
            # with a cosine over t the interval lies elsewhere: its ends are the extremes over all cosines from t to 1
            low = np.where(u[focus] <= -t, -1.0, np.minimum(low, u[focus]))
            high = np.where(u[focus] >= t, 1.0, np.maximum(high, u[focus]))
            spans = [(np.searchsorted(sorted_[:, f], a, "left"), np.searchsorted(sorted_[:, f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
            least = min(range(len(focus)), key=lambda k: spans[k][1] - spans[k][0])
            rows = lists[spans[least][0] : spans[least][1], focus[least]]
            inside = unit[rows][:, focus]
            rows = np.sort(rows[((inside >= low) & (inside <= high)).all(axis=1)])
            seen["coordinate"] += len(rows)
            if len(rows):
                queries.offer(q, ids[rows], valid[rows], products(queries.x[q : q + 1], x[rows])[0])
    flat = open_[~steep] if len(open_) else open_
    for start in range(0, len(flat), FEW_QUERIES):
        some = flat[start : start + FEW_QUERIES]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(queries.floor[some] > 0, queries.floor[some] / queries.length[some] * (1 - SLACK), 0)
        upto = np.searchsorted(-length, -needed, "right")
        most = int(upto.max(initial=0))
        scores = products(queries.x[some], x[:most])
        for k, q in enumerate(some.tolist()):
            seen["length"] += int(upto[k])
            queries.offer(q, ids[: upto[k]], valid[: upto[k]], scores[k, : upto[k]])
    return seen


def _search(vectors: DataFrame, block, top: int) -> DataFrame:
    """(query, score, vec_id): the best rows of each task for every query of the block; ``query`` is its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, ids, x, floor = block.value
        queries = Queries(ids, x, floor, top)
        held: list[tuple] = []
        key, size = None, 0

        def close():
            search_tile(queries, *(np.concatenate([h[i] for h in held]) for i in range(3)))

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            for start in np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1 if len(buckets) else 0)).tolist():
                end = start + int(np.argmax(np.append(buckets[start:] != buckets[start], True)))
                for s in range(start, end, TILE):
                    part = batch.slice(s, min(TILE, end - s))
                    if held and (key != buckets[start] or size + part.num_rows > TILE):
                        close()
                        held, size = [], 0
                    key, size = buckets[start], size + part.num_rows
                    known = part.column("vec_id")
                    held.append((known.fill_null(0).to_numpy(zero_copy_only=False), ~known.is_null().to_numpy(zero_copy_only=False), matrix(part.column("x"))))
        if held:
            close()
        found = [(q, -s, None if null else i) for q, best in enumerate(queries.best) for s, null, i in best]
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "score", "vec_id"]
        )

    return vectors.select("vec_id", "x", "bucket").mapInArrow(run, "query long, score long, vec_id long")


def top_products(vectors: DataFrame, queries: DataFrame, top: int = TOP, name: str = "topk") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of ``vectors`` with the largest inner product, for every query; exact.

    Both tables: (vec_id, x) with whole numbers in ``x``. Rows with the query's own key are not among its partners; ties go
    to the smaller key, null keys last. Repeated rows (key and vector) count once; if a key has two vectors, both are
    searched for. Only vectors of the same dimension are compared. A query with fewer partners returns them all. Scores
    beyond 64 bits are an error. Empty tables give an empty result.

    Queries go in blocks of 16 MB; every block is sent to the tasks, which pass once over all vectors, longest first, and
    keep the best rows of each query. A first pass over about SEEDS vectors gives every query a threshold to begin with; it
    only speeds up, since what reaches the threshold is kept. A task returns at most ``top`` rows a query.
    """
    spark = vectors.sparkSession
    table = by_length(vectors, f"{name}-vectors")
    asked = queries.select("vec_id", "x").distinct().withColumn("dim", F.size("x"))
    sizes = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, -(-n * max(1, d) * 8 // BLOCK_BYTES))]) if sizes else F.lit(None)
    hashed = F.xxhash64("vec_id", "x")
    blocks = stored(asked.withColumn("block", F.pmod(hashed, parts[F.col("dim")]).cast("int") if sizes else F.lit(0)), f"{name}-queries")
    found = []
    for dim, count in sorted(sizes.items()):
        same = table.filter(F.col("dim") == dim)
        total = same.count()
        every = max(1, total // SEEDS)
        for k in range(-(-count * max(1, dim) * 8 // BLOCK_BYTES)):
            rows = blocks.filter((F.col("dim") == dim) & (F.col("block") == k)).orderBy("vec_id", "x").toArrow()
            if not rows.num_rows:
                continue
            ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("x").combine_chunks())
            floor = None
            if every > 1:
                seeds = _search(same.filter(F.pmod("spread", F.lit(every)) == 0), spark.sparkContext.broadcast((dim, ids, x, None)), top)
                least = _best(seeds, "query", top).groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
                floor = np.full(len(ids), -np.inf)
                for r in least.filter(F.col("n") == top).collect():
                    floor[r["query"]] = r["least"]
            best = _best(_search(same, spark.sparkContext.broadcast((dim, ids, x, floor)), top), "query", top)
            names = spark.createDataFrame(pa.table({"query": np.arange(len(ids)), "query_id": ids}))
            joined = best.join(F.broadcast(names), "query")
            found.append(stored(joined.select("query_id", "rank", "vec_id", "score"), f"{name}-block"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _best(rows: DataFrame, query: str, top: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows with the largest products for every row whose key is divisible by 100, over floor(1024 * x)."""
    vectors = stored(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 1024), "topk-whole")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLES = {
    "op12_exact_topk": """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT DISTINCT vec_id, x FROM w),
p AS (SELECT q.vec_id AS query_id, q.x AS qx, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id IS DISTINCT FROM v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
