"""Exact top-k inner-product search by a pivot table.

Vectors x are lifted to x' = (x, sqrt(M^2 - |x|^2)), M the largest norm, and queries to q' = (q, 0), so that the
largest inner products are the smallest distances. The table keeps each vector's distances to 32 pivots; for a query,
|d(q',p) - d(x',p)| bounds the distance from below for every pivot, and so the inner product from above. Candidates are
evaluated in order of that bound until no bound reaches the k-th best exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import lean, stored

PIVOTS, SAMPLE, BLOCK, SCALE = 32, 1024, 2048, 1024


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id, vec (floor of 1024 times each component) and row, a number that tells rows apart once the result is stored.
    Rows with a null id, a null vector or a component that is null or not finite take no part; every other row does, also
    under a repeated id. Vectors of different lengths meet on their common components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long"), whole.alias("vec"), F.monotonically_increasing_id().alias("row"))


#: Squared norms from here on need integers: below, no sum of products of two vectors leaves the exact range of float64.
WIDE = 2.0**53


def _matrix(column: pa.ListArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), width), kind)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    if len(column) and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width).astype(kind)
    for i in range(len(column)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as integers; those in float64 are whole numbers already."""
    return scores if scores.dtype == np.int64 else np.rint(scores).astype(np.int64)


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Rows far from one another, each the farthest from those chosen before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def data_distances(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances between lifted vectors; top is M^2."""
    lift = lambda v: np.sqrt(np.maximum(top - (v**2).sum(1), 0))
    return np.sqrt(np.maximum(2 * top - 2 * (x @ pivots.T + np.outer(lift(x), lift(pivots))), 0))


def query_distances(q: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + top - 2 * q @ pivots.T, 0))


class Best:
    """The k best (score, smaller id) of each query so far; ids may repeat."""

    def __init__(self, queries: int, k: int, kind: type = np.float64):
        self.k = k
        self.score = [np.empty(0, kind) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]

    def floor(self, q: int) -> float:
        return self.score[q][-1] if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.ids[q] = s[order], i[order]


def eliminate(best: Best, q: int, other: np.ndarray, query: np.ndarray, dq: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, top: float) -> int:
    """Add a block of candidates to one query's best; other: which of them are not the query's own row. query and x are
    float64, or int64 where float64 would round scores; bounds are float64 always. Returns how many were evaluated."""
    bound = np.abs(dx - dq).max(1)
    norm = float((query.astype(np.float64) ** 2).sum())
    upper = (norm + top - bound**2) / 2
    upper += 1e-9 * (abs(top) + norm) + 1e-3  # the bounds are rounded, the scores are exact
    open_ = np.flatnonzero((upper >= best.floor(q)) & other)
    open_ = open_[np.argsort(-upper[open_], kind="stable")]
    at, step = 0, 32
    while at < len(open_) and upper[open_[at]] >= best.floor(q):
        part = open_[at : at + step]
        best.add(q, x[part] @ query, ids[part])
        at, step = at + step, step * 2
    return min(at, len(open_))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best rows other than itself, ties to the smaller id; query rows
    with one id have ranks of their own.

    vectors, queries: from integer_vectors(), read from files (queries are rows of vectors). Queries run in blocks of about 2048, which is all that
    is sent to the tasks; every task keeps k rows a query, and those meet by query.
    """
    spark = vectors.sparkSession
    facts = vectors.agg(F.max(F.size("vec")).alias("width"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if facts["width"] is None:
        return empty
    width, top = facts["width"], float(facts["top"])
    sample = vectors.orderBy(F.xxhash64("vec_id", "row"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    pivots = choose_pivots(_matrix(sample, width))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = data_distances(_matrix(b.column(1), width), pivots, top)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))], ["vec_id", "vec", "row", "far"])

    pivot_table = stored(vectors.select("vec_id", "vec", "row").mapInArrow(measure, "vec_id long, vec array<long>, row long, far array<double>"))
    blocks = max(1, -(-queries.count() // block))
    dealt = stored(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))

    def search(one: pa.Table) -> DataFrame:
        own, named = one.column("row").to_numpy(), one.column("vec_id").to_numpy()
        q = _matrix(one.column("vec").combine_chunks(), width)
        dq = query_distances(q, pivots, top)
        kind = np.int64 if top >= WIDE else np.float64
        asked = _matrix(one.column("vec").combine_chunks(), width, kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(own), k, kind)
            for b in batches:
                ids, x, rows, dx = b.column(0).to_numpy(), _matrix(b.column(1), width, kind), b.column(2).to_numpy(), _matrix(b.column(3), len(pivots))
                for i in range(len(own)):
                    eliminate(best, i, rows != own[i], asked[i], dq[i], ids, x, dx, top)
            n = [len(s) for s in best.score]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(named, n)), "query_row": pa.array(np.repeat(own, n)), "vec_id": pa.array(np.concatenate([*best.ids, np.empty(0, np.int64)]).astype(np.int64)), "score": pa.array(_whole(np.concatenate([*best.score, np.empty(0, kind)])))})

        found = pivot_table.mapInArrow(lean(run), "query_id long, query_row long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = [search(one) for i in range(blocks) if (one := dealt.filter(F.col("block") == i).select("vec_id", "vec", "row").toArrow()).num_rows]
    if len(out) > 1:
        out = [stored(x) for x in out]
    result = out[0] if out else empty
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def search_embeddings(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    vectors = stored(integer_vectors(embeddings))
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of every query row (vec_id divisible by 100). Empty tables give no rows."""
    return search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH each AS (SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
parts AS (SELECT n, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM each),
bad AS (SELECT DISTINCT n FROM parts WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT n, vec_id, i, CAST(floor(1024 * x) AS BIGINT) AS x FROM parts WHERE n NOT IN (SELECT n FROM bad)),
s AS (
  SELECT q.n AS q, q.vec_id AS query_id, c.n, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.n <> c.n
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3, 4)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
