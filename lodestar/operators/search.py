"""Nearest-neighbour search over vectors: exact, by sign codes, and routed through clusters.

Queries come as a table. They are taken in blocks of checked size; each block is shipped to the tasks, which scan the
vectors once with matrix products of bounded size and keep the k best of the whole task; one exchange by query merges these.
Ranks are by score rounded to six digits and then by id, so ties are settled alike everywhere; NaN ranks last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Bytes of query vectors (as double), routes and kept rows of one pass; more queries take more passes.
BLOCK_BYTES = 32 << 20
#: Bytes of scores that a task holds at once: of some queries and the rows of a batch.
TILE_BYTES = 16 << 20
#: Rows that a task gathers at least before it drops those beyond the k best, and rows of a batch of results.
KEPT_ROWS = 100_000
DIGITS = 6


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """n x d doubles of a list column; a row of another length, or null, becomes NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    d = dim if dim is not None else int(sizes.max(initial=0))
    if n and (sizes == d).all() and column.null_count == 0:
        flat = column.flatten()
        return np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(n, d)
    out = np.full((n, d), np.nan)
    for i in np.flatnonzero(sizes == d):
        out[i] = [np.nan if x is None else x for x in column[int(i)].as_py()]
    return out


def _best(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row that reach its ``least``; equal ones go by column, NaN comes last."""
    n = scores.shape[1]
    empty = np.isnan(scores)
    s = np.where(empty, -np.inf, np.maximum(scores, np.finfo(float).min)) if empty.any() else scores
    hit = s >= least[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
    if len(many):
        mine = s[many]
        edge = np.partition(mine, n - k, axis=1)[:, n - k, None]
        above, at = mine > edge, mine == edge
        left = k - np.count_nonzero(above, axis=1)
        tied = np.flatnonzero(np.count_nonzero(at, axis=1) > left)
        at[tied] &= np.cumsum(at[tied], axis=1, dtype=np.int32) <= left[tied, None]
        hit[many] = above | at
    return np.nonzero(hit)


class _Top:
    """The k best (query, row, score) of each query seen so far, in memory bounded by the number of queries times k."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.size = k, np.full(n, -np.inf), 0
        self.limit = max(KEPT_ROWS, 2 * n * k)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def add(self, asked: np.ndarray, rows: pa.Array, scores: np.ndarray) -> None:
        if len(asked):
            self.parts.append((asked, rows, scores))
            self.size += len(asked)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> None:
        asked, scores = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        rows = pa.concat_arrays([p[1] for p in self.parts])
        order = np.lexsort((np.asarray(pc.rank(rows, null_placement="at_start", tiebreaker="dense")), -scores, asked))  # NaN comes last
        mine = asked[order]
        first = np.searchsorted(mine, mine)
        order = order[np.arange(len(mine)) - first < self.k]
        asked, rows, scores = asked[order], rows.take(pa.array(order)), scores[order]
        self.parts, self.size = [(asked, rows, scores)], len(asked)
        last = np.flatnonzero(np.bincount(asked, minlength=len(self.least))[asked] == self.k)[self.k - 1 :: self.k]  # the k-th of each full query
        self.least[asked[last]] = np.where(np.isnan(scores[last]), -np.inf, scores[last])


def _blocks(queries: DataFrame, k: int, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The queries (query_id, q, and any others) in blocks of about ``limit`` bytes, their k best rows counted in; their size is asked for first."""
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    blocks = max(1, -(-n * (8 * (width or 1) + 64 + 64 * k) // limit))  # a kept row takes 24 bytes, twice, and is sorted
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        yield part.toArrow()


def _scan(vectors: DataFrame, queries: DataFrame, k: int, kind: str, routed: bool, limit: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, row_id, score): partial top-k of each task. ``vectors``: (row_id, v[, cluster_id]); ``queries``: (query_id, q[, clusters])."""
    spark = vectors.sparkSession
    ids = vectors.select("row_id").schema[0].dataType.simpleString(), queries.select("query_id").schema[0].dataType.simpleString()
    columns = ["row_id", "v", *(["cluster_id"] if routed else [])]
    out = None
    for table in _blocks(queries, k, limit):
        if not table.num_rows:
            continue
        q = _matrix(table.column("q"))
        clusters: dict[int, np.ndarray] = {}
        if routed:
            mine = table.column("clusters").combine_chunks()
            of, who = np.asarray(mine.flatten()), np.asarray(pc.list_parent_indices(mine))
            order = np.argsort(of, kind="stable")
            keys, begin = np.unique(of[order], return_index=True)
            clusters = dict(zip(keys.tolist(), np.split(who[order], begin[1:]), strict=True))
        shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), q, clusters))  # at most a block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, clusters = shared.value
            everyone, top = np.arange(len(q)), _Top(len(q), k)
            for batch in batches:
                if not len(batch):
                    continue
                batch = batch.sort_by("row_id")
                x = _matrix(batch.column(1), q.shape[1])
                if kind == "sign":
                    x = np.where(x > 0, 1.0, -1.0)
                groups = [(np.arange(len(x)), everyone)]
                if routed:
                    of = np.asarray(batch.column(2))
                    groups = [(np.flatnonzero(of == c), clusters[c]) for c in np.unique(of).tolist() if c in clusters]
                for rows, asked in groups:
                    mine = x[rows]
                    step = max(1, TILE_BYTES // (8 * len(rows)))
                    for a in range(0, len(asked), step):
                        who = asked[a : a + step]
                        with np.errstate(invalid="ignore"):
                            s = q[who] @ mine.T
                            np.round(s, DIGITS, out=s)
                        r, c = _best(s, k, top.least[who])
                        top.add(who[r], batch.column(0).take(pa.array(rows[c])), s[r, c] + 0.0)
            if top.size:
                top.cut()
                asked, rows, scores = top.parts[0]
                for a in range(0, len(asked), KEPT_ROWS):
                    part = slice(a, a + KEPT_ROWS)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(asked[part])), rows[part], pa.array(scores[part])], names=["query_id", "row_id", "score"])

        source = vectors
        if routed:
            wanted = sorted(clusters)
            source = vectors.filter(F.col("cluster_id").isin(wanted)) if len(wanted) <= 4096 else vectors
        found = source.select(*columns).mapInArrow(run, f"query_id {ids[1]}, row_id {ids[0]}, score double")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"query_id {ids[1]}, row_id {ids[0]}, score double") if out is None else out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank) of the k best of each query; the limit is taken on both sides of the exchange."""
    s = F.when(~F.isnan("score"), F.col("score"))
    order = Window.partitionBy("query_id").orderBy(s.desc_nulls_last(), "row_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """The k vectors of the largest inner product with each query."""
    return ranked(_scan(vectors, queries, k, "dot", False, **options), k)


def sign_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """The same by sign codes: the sum of the query's values, each with the sign of the vector's."""
    return ranked(_scan(vectors, queries, k, "sign", False, **options), k)


@dataclass
class ClusterIndex:
    """``vectors`` (row_id, v, cluster_id, any facet columns) and ``centroids`` (cluster_id, c)."""

    vectors: DataFrame
    centroids: DataFrame


def _shipped(centroids: DataFrame):
    """Centroids as (matrix, ids in order) for the tasks, after a check of their size."""
    table = centroids.orderBy("cluster_id").toArrow()
    if table.num_rows == 0:
        raise ValueError("no centroids")
    c, names = _matrix(table.column("c")), np.asarray(table.column("cluster_id").combine_chunks())
    if c.nbytes > 16 * BLOCK_BYTES:
        raise ValueError(f"centroids of {c.nbytes} bytes are too many for one pass")
    return centroids.sparkSession.sparkContext.broadcast((c, names))


def _products(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rounded products with NaN as the smallest) of slices of about 64 MB."""
    step = max(1, (64 << 20) // (8 * len(c)))
    for a in range(0, len(x), step):
        s = np.round(x[a : a + step] @ c.T, DIGITS)
        yield a, np.where(np.isnan(s), -np.inf, s)


def route(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, cluster_id, score, rank): the ``nprobe`` clusters of the largest inner product with each query.

    Filters play no part. With fewer clusters all are taken. No exchange.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    shared = _shipped(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = shared.value
        k = min(nprobe, len(c))
        for batch in batches:
            for a, s in _products(_matrix(batch.column(1), c.shape[1]), c):
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                who = pa.array(np.repeat(np.arange(a, a + len(s)), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(names[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel() + 0.0), pa.array(np.tile(np.arange(1, k + 1), len(s)))], names=["query_id", "cluster_id", "score", "rank"])

    kinds = queries.select("query_id").schema[0].dataType.simpleString(), centroids.select("cluster_id").schema[0].dataType.simpleString()
    return queries.select("query_id", "q").mapInArrow(run, f"query_id {kinds[0]}, cluster_id {kinds[1]}, score double, rank long")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` (row_id, v, …) with cluster_id: the centroid of the largest inner product, the lowest id on ties.

    No exchange: each batch meets the centroids, whose size is checked, in one product.
    """
    shared, at = _shipped(centroids), vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = shared.value
        for batch in batches:
            best = np.zeros(len(batch), np.int64)
            for a, s in _products(_matrix(batch.column(at), c.shape[1]), c):
                best[a : a + len(s)] = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best])], names=[*batch.schema.names, "cluster_id"])

    kind = centroids.select("cluster_id").schema[0].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, cluster_id {kind}")


def label_centroids(vectors: DataFrame, label: str, dim: int) -> DataFrame:
    """Mean vectors of labels, each value rounded to six digits: deterministic centroids. Sums are partial."""
    means = vectors.groupBy(F.col(label).alias("cluster_id")).agg(*(F.round(F.avg(F.col("v")[i].cast("double")), DIGITS).alias(f"m{i}") for i in range(dim)))
    return means.select("cluster_id", F.array(*(f"m{i}" for i in range(dim))).alias("c"))


def train_centroids(vectors: DataFrame, k: int, sample: int = 500_000, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """k-means centroids of a bounded, seeded sample; assignment stays by inner product. Fewer rows than k: the rows themselves."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    drawn = vectors.select("row_id", "v").filter("v is not null").orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(sample)
    n = drawn.count()
    spark = vectors.sparkSession
    if n <= k:
        rows = [r["v"] for r in drawn.orderBy("row_id").collect()]  # at most k rows
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "cluster_id int, c array<double>")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="f").fit(drawn.select(array_to_vector(F.col("v").cast("array<double>")).alias("f")))
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, c array<double>")


def build(vectors: DataFrame, centroids: DataFrame) -> ClusterIndex:
    return ClusterIndex(assign(vectors, centroids), centroids)


def lists(index: ClusterIndex) -> DataFrame:
    """Posting lists in their stored order: by cluster, rows ascending."""
    return index.vectors.repartitionByRange("cluster_id", "row_id").sortWithinPartitions("cluster_id", "row_id")


def search(index: ClusterIndex, queries: DataFrame, nprobe: int = 8, n_coarse: int = 50, where: Column | None = None, allow: DataFrame | None = None, kind: str = "sign") -> DataFrame:
    """(query_id, row_id, score, rank): route each query, scan its clusters, keep the ``n_coarse`` best.

    ``where`` is a predicate on the vectors' columns and ``allow`` a table of row_id; both act inside the scan, before
    anything is ranked, so a filter may leave fewer rows than asked for. With every cluster probed this is the brute force.
    """
    routes = route(queries, index.centroids, nprobe)
    asked = queries.select("query_id", "q").join(routes.groupBy("query_id").agg(F.sort_array(F.collect_list("cluster_id")).alias("clusters")), "query_id")
    rows = index.vectors if where is None else index.vectors.filter(where)
    if allow is not None:
        rows = rows.join(allow.select("row_id").distinct(), "row_id", "left_semi")
    return ranked(_scan(rows, asked, n_coarse, kind, True), n_coarse)


def check_queries(queries: DataFrame, dim: int) -> DataFrame:
    """The queries, with an error where a vector is not finite or not of ``dim`` values."""
    from ..functions import vectors as V

    return queries.withColumn("q", V.checked("q", dim))


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """One row of violation counts: rows, repeated ids, wrong dimension, not finite."""
    from ..functions import vectors as V

    repeated = vectors.groupBy("row_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
    if not isinstance(vectors.schema["v"].dataType, ArrayType):
        raise ValueError("v must be an array")
    counts = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.size("v") != dim, F.lit(True))).alias("wrong_dim"), F.count_if(~V.is_finite("v")).alias("not_finite"))
    return counts.crossJoin(repeated)  # one row each


def partition_violations(index: ClusterIndex, n_rows: int) -> DataFrame:
    """One row: rows in no or several lists, ids out of range, and lists of unknown clusters."""
    per_row = index.vectors.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    rows = per_row.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("row_id") < 0) | (F.col("row_id") >= n_rows)).alias("out_of_range"), (F.lit(n_rows) - F.count_if((F.col("row_id") >= 0) & (F.col("row_id") < n_rows))).cast("long").alias("missing"))
    unknown = index.vectors.groupBy("cluster_id").count().join(index.centroids.select("cluster_id"), "cluster_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_clusters"))
    return rows.crossJoin(unknown)  # one row each
