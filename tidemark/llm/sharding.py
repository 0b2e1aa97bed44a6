"""Consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

Rows meet the ring in order of an arrival hash. A row belongs to the first virtual node clockwise of its position; if
that node's shard is full, it goes on clockwise to the next shard with room. All rows of one arc (the positions between
two virtual nodes) that arrive in the same round meet the same shards in the same order, so the walk is done over the
counts of (round, arc) slices, rounds x shards x virtual nodes numbers at most, and each slice then hands its rows out
by rank.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, stored

POSITIONS = 2**52


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. A shard's positions depend on its own number only."""
    at = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            at.setdefault(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % POSITIONS, s)
    return sorted(at.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack they add up to all rows and differ by one at most."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack)) // shards) + 1] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Hand out slices in order of arrival: (slice, first rank, end rank, shard, slot of the first rank)."""
    arcs, left, out = len(nodes), list(room), []
    filled = [0] * len(room)
    for piece in sorted(counts):
        rank, arc, n = 0, piece % arcs, counts[piece]
        for step in range(arcs):
            shard = nodes[(arc + step) % arcs][1]
            take = min(left[shard], n - rank)
            if take:
                out.append((piece, rank, rank + take, shard, filled[shard]))
                left[shard] -= take
                filled[shard] += take
                rank += take
            if rank == n:
                break
    return out


def assign(df: DataFrame, key: str, tie: list[str], shards: int = 16, virtual_nodes: int = 64, slack: float = 0.0, rounds: int = 32) -> DataFrame:
    """Add `shard` and `slot` (gapless from 0 within a shard) to every row of df.

    slack: a shard takes at most (1 + slack) times the mean; 0 keeps counts within one of each other. Rows whose key
    is null are placed by their tie columns, so they spread like other rows. Rows equal in key and tie columns are
    interchangeable. df must come from files (it is read twice). An empty frame gives an empty result.
    """
    spark, nodes = df.sparkSession, ring(shards, virtual_nodes)
    arcs = len(nodes)
    own = F.when(F.col(key).isNull(), F.xxhash64(*tie)).otherwise(F.xxhash64(F.col(key)))
    at = F.shiftrightunsigned(own, 12)
    placed = df.withColumn("_own", own).withColumn("_at", at.cast("double"))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-1.0, *[float(p) for p, _ in nodes], float(POSITIONS)], inputCol="_at", outputCol="_arc")
    arrival = F.xxhash64(F.lit("arrival"), "_own")
    placed = cut.transform(placed).withColumn("_arrival", arrival)
    placed = placed.withColumn("_slice", (F.pmod("_arrival", F.lit(rounds)) * arcs + F.pmod(F.col("_arc").cast("long"), F.lit(arcs))).cast("int"))
    counts = {r["_slice"]: r["count"] for r in placed.groupBy("_slice").count().collect()}
    plan = walk(counts, nodes, capacities(sum(counts.values()), shards, slack))
    given = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "_slice int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(W.partitionBy("_slice").orderBy("_arrival", key, *tie)) - 1
    ranked = placed.withColumn("_rank", rank)
    # given has at most rounds x arcs rows, and one more for each time a shard fills up
    out = ranked.join(F.broadcast(given), (ranked["_slice"] == given["_slice"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return out.select(*[df[c] for c in df.columns], "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def owner(position: int, nodes: list[tuple[int, int]]) -> int:
    """The shard that an empty ring gives a position (for tests and for lookups by hand)."""
    at = bisect_right([p for p, _ in nodes], position)
    return nodes[at % len(nodes)][1]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards, counts at most one apart. Null texts have no bytes; null ids are placed by text."""
    return shard_documents(documents(spark, sf_dir))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every row. Null texts have no bytes, null ids are placed by text and size, rows that repeat an id meet
    at one place of the ring and go on to the next shard when it is full; equal rows are interchangeable. Texts are measured
    where they are read, whatever their length. Other columns are not read. An empty table gives no rows."""
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = stored(docs.select(F.col("doc_id").cast("long"), (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32")))
    out = assign(small, "doc_id", ["text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
