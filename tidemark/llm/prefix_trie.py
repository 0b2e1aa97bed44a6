"""A trie of conversations by their turns, as balanced parentheses.

Conversations are sequences of turns (role, text). A prefix is named by 128 bits: the exclusive or of a hash of each of its
turns with its place, so a running aggregate names all prefixes and any turn's parent without its text. Results are exact
up to collisions of those names. Texts never leave the task that reads them.

Nodes with more than HEAVY members are the spine; its size is bounded. Below it hang light subtrees, which are dealt to
shards. A shard writes its subtrees as one sequence of parentheses in preorder; findclose over a range-min tree of excess
gives the end of each subtree, rank of `()` its leaves, cumulative sums its savings. Subtrees hand their sums to their parent
in the spine, which is then encoded the same way; so spines that several shards share merge. Very deep conversations are cut
into bands of BAND turns, worked from the deepest up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, stored

#: Members beyond which a node belongs to the spine, and most nodes that the spine may have about.
HEAVY, MOST_SPINE = 64, 1 << 18
#: Turns of one conversation that are ranked and named in one group, and depth of a band.
BLOCK, BAND = 1024, 4096
#: Nodes a shard has about; there are at least SHARDS.
SHARD_NODES, SHARDS = 1 << 16, 256
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# --- balanced parentheses ---------------------------------------------------------------------------------------------


class Parentheses:
    """bits (1 opens, 0 closes) of a forest in preorder, with a range-min tree over the excess of blocks."""

    def __init__(self, bits: np.ndarray, block: int = 256):
        self.bits, self.block, self.n = bits, block, len(bits)
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = max(1, -(-self.n // block))
        padded = np.full(blocks * block, np.iinfo(np.int64).max)
        padded[: self.n] = self.excess
        self.rows = padded.reshape(blocks, block)
        self.leaves = 1 << (blocks - 1).bit_length()
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves : self.leaves + blocks] = self.rows.min(1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            self.least[a : 2 * a] = np.minimum(self.least[2 * a : 4 * a : 2], self.least[2 * a + 1 : 4 * a : 2])

    def _in_block(self, row: np.ndarray, after: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place in each row beyond `after` with an excess of goal or less, -1 without one."""
        out = np.empty(len(row), np.int64)
        for at in range(0, len(row), 8192):
            s = slice(at, at + 8192)
            hit = (self.rows[row[s]] <= goal[s, None]) & (np.arange(self.block) > after[s, None])
            out[s] = np.where(hit.any(1), hit.argmax(1), -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place where the excess is one less than at it."""
        goal, row = self.excess[opens] - 1, opens // self.block
        place = self._in_block(row, opens % self.block, goal)
        far = np.flatnonzero(place < 0)
        node, g = row[far] + self.leaves, goal[far]
        up = np.ones(len(far), bool)
        while up.any():  # to the first subtree on the right that goes as low
            right = (node & 1) == 0
            found = up & right & (self.least[np.minimum(node + 1, len(self.least) - 1)] <= g)
            node = np.where(found, node + 1, np.where(up, node >> 1, node))
            up &= ~found
        down = node < self.leaves
        while down.any():  # to its first block that does
            left = np.minimum(2 * node, len(self.least) - 1)
            node = np.where(down, left + (self.least[left] > g), node)
            down = node < self.leaves
        found_row = row.copy()
        found_row[far] = node - self.leaves
        place[far] = self._in_block(found_row[far], np.full(len(far), -1), g)
        return found_row * self.block + place


def preorder(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in preorder, parentheses) of a forest; parent is -1 at roots. Siblings keep their order."""
    n = len(parent)
    by = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by], np.arange(-1, n + 1)).tolist()
    kids = by.tolist()
    order, bits, todo = [], bytearray(), kids[first[0] : first[1]][::-1]
    while todo:
        v = todo.pop()
        if v < 0:
            bits.append(0)
            continue
        order.append(v)
        bits.append(1)
        todo.append(-1)
        todo.extend(kids[first[v + 1] : first[v + 2]][::-1])
    return np.asarray(order, np.int64), np.frombuffer(bytes(bits), np.uint8)


def measured(parent: np.ndarray, saving: np.ndarray, below: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(children, leaves, savings) of each node of a forest. below, leaves and saved: children, leaves and savings that a
    node has in other pieces."""
    order, bits = preorder(parent)
    tree = Parentheses(bits)
    opens = np.flatnonzero(bits)
    close = tree.findclose(opens)
    # a "()" is a leaf unless its node has children elsewhere; what lies elsewhere is counted at the opening parenthesis
    pair = np.zeros(len(bits), np.int64)
    pair[opens] = leaves[order] + ((bits[np.minimum(opens + 1, len(bits) - 1)] == 0) & (below[order] == 0))
    ranks, sums = np.concatenate([[0], np.cumsum(pair)]), np.concatenate([[0], np.cumsum((saving + saved)[order])])
    size = (close - opens + 1) // 2
    at = np.arange(len(order))
    out = [np.zeros(len(parent), np.int64) for _ in range(3)]
    out[0][:] = below
    np.add.at(out[0], parent[parent >= 0], 1)
    out[1][order], out[2][order] = ranks[close + 1] - ranks[opens], sums[at + size] - sums[at]
    return tuple(out)


# --- rebuilt conversations --------------------------------------------------------------------------------------------


def _head(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 9


def _running(df: DataFrame, by: list[str], order: str, columns: list[str], key: str) -> DataFrame:
    """columns of the rows of a block (by, key) become their exclusive or with all earlier ones of `by`."""
    within = W.partitionBy(*by, key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    many = df.groupBy(*by, key).agg(*[F.bit_xor(c).alias(c) for c in columns])
    ahead = many.select(*by, key, *[F.bit_xor(c).over(before).alias(f"_{c}") for c in columns]).filter(F.col(key) > 0)
    x = df.withColumns({c: F.bit_xor(c).over(within) for c in columns}).join(ahead, [*by, key], "left")
    return x.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0).cast("long"))) for c in columns}).drop(*[f"_{c}" for c in columns])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ends): every rebuilt conversation's turns (c, p, k1, k2, q1, q2, bytes), k the name of the prefix that ends
    at place p, q that of its parent; and (c, k1, k2), the name of each whole conversation.

    Turns of one conversation with equal numbers go by the hash of role and text; equal rows are interchangeable.
    """
    text = F.coalesce("text", F.lit("")).cast("string")
    role = F.coalesce("role", F.lit("")).cast("string")
    turn = F.col("turn").cast("long")
    slim = stored(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), turn.alias("turn"), F.coalesce(F.floor(turn / BLOCK), F.lit(-(2**62))).alias("tb"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
    ))
    blocks = slim.groupBy("c", "tb").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("tb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy("c"))
    blocks = blocks.select("c", "tb", ahead.alias("ahead"), total.alias("own"))
    own = blocks.select("c", "own").distinct()
    facts = own.withColumn("base", F.col("c") - F.col("c") % 5).join(own.select(F.col("c").alias("base"), F.col("own").alias("there")), "base", "left")
    facts = facts.select("c", "base", "own", F.least(_head(F.col("c")), F.coalesce("there", F.lit(0))).alias("head"))
    facts = stored(facts.withColumn("length", F.col("head") + F.greatest(F.col("own") - _head(F.col("c")), F.lit(0))))
    rank = F.row_number().over(W.partitionBy("c", "tb").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    places = stored(slim.withColumn("rank", rank).join(blocks.drop("own"), ["c", "tb"]).withColumn("rank", F.col("rank") + F.col("ahead")).select("c", "tb", "rank", "a", "b", "bytes"))
    mine = places.filter(F.col("rank") > _head(F.col("c"))).join(blocks.select("c", "tb").join(facts.select("c", "head"), "c"), ["c", "tb"])
    mine = mine.select("c", (F.col("head") + F.col("rank") - _head(F.col("c"))).alias("p"), "a", "b", "bytes")
    shared = places.filter((F.col("rank") <= 8) & (F.col("c") % 5 == 0)).select(F.col("c").alias("base"), F.col("rank").alias("p"), "a", "b", "bytes")
    theirs = shared.join(facts.select("c", "base", "head"), "base").filter("p <= head").select("c", "p", "a", "b", "bytes")
    x = mine.unionByName(theirs).select("c", "p", F.floor(F.col("p") / BLOCK).alias("pb"), F.xxhash64("p", "a").alias("f1"), F.xxhash64("b", "p").alias("f2"), "bytes")
    x = _running(x.withColumns({"k1": F.col("f1"), "k2": F.col("f2")}), ["c"], "p", ["k1", "k2"], "pb")
    turns = stored(x.select("c", "p", "k1", "k2", F.col("k1").bitwiseXOR(F.col("f1")).alias("q1"), F.col("k2").bitwiseXOR(F.col("f2")).alias("q2"), "bytes"))
    last = turns.groupBy("c").agg(F.max_by(F.struct("k1", "k2"), "p").alias("k"))
    ends = facts.select("c").join(last, "c", "left").select("c", F.coalesce("k.k1", F.lit(0)).alias("k1"), F.coalesce("k.k2", F.lit(0)).alias("k2"))
    ends = stored(ends)
    for used in (slim, places, facts):
        forget(used)
    return turns, ends


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of every name at which conversations end.

    Ids are joined to texts by ranges of 4096 ids; a name's texts then pass through one hash in order, as SHA-256 demands,
    without being held together.
    """
    import hashlib

    import pyarrow as pa

    part = ends.groupBy("k1", "k2", F.floor(F.col("c") / 4096).alias("_r")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids"))
    part = part.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "_r").select("k1", "k2", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k1": pa.array([k[0] for k, _ in rows], pa.int64()), "k2": pa.array([k[1] for k, _ in rows], pa.int64()), "ends_sha256": pa.array([h for _, h in rows], pa.string())})

        for b in batches:
            done = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, k2) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield batch(done)
        if key is not None:
            yield batch([(key, state.hexdigest())])

    return part.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------------------------------------------

_NODE = "k1 long, k2 long, q1 long, q2 long, conv_id long, depth long, n_convs long, bytes long, below long, leaves long, saved long"
_OUT = "k1 long, k2 long, q1 long, q2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def encoded(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard with what the parentheses say of each; parents outside the shard make a node a root."""
    nodes = nodes.sort_values(["depth", "conv_id", "k1", "k2"], ignore_index=True)
    place = pd.Series(np.arange(len(nodes)), index=pd.MultiIndex.from_frame(nodes[["k1", "k2"]]))
    parent = place.reindex(pd.MultiIndex.from_frame(nodes[["q1", "q2"]])).fillna(-1).to_numpy().astype(np.int64)
    parent[parent == np.arange(len(nodes))] = -1  # the root is named like its own parent
    saving = ((nodes["n_convs"] - 1) * nodes["bytes"]).to_numpy(np.int64)
    got = measured(parent, saving, *(nodes[c].to_numpy(np.int64) for c in ("below", "leaves", "saved")))
    out = nodes[["k1", "k2", "q1", "q2", "conv_id", "depth"]].copy()
    mother = pd.array(nodes["conv_id"].to_numpy()[np.maximum(parent, 0)], dtype="Int64")
    mother[parent < 0] = pd.NA
    out["parent_conv_id"], out["n_convs"] = mother, nodes["n_convs"]
    out["n_children"], out["n_leaves"], out["saved_tokens"] = got
    return out


def _with_extras(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """nodes with what roots of other pieces hand to their parents."""
    if roots is None:
        return nodes.withColumns({c: F.lit(0).cast("long") for c in ("below", "leaves", "saved")})
    up = roots.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return nodes.join(up, ["k1", "k2"], "left").fillna(0, ["below", "leaves", "saved"])


def trie(conversations: DataFrame, heavy: int = HEAVY, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty ones, null turns come first, turns with equal numbers go by a hash, repeated rows are
    turns of their own. Rows of null conv_id belong to no conversation. Without conversations there is no node, not even a
    root. Other columns are not read. Texts of any length are hashed where they are read.
    """
    spark = conversations.sparkSession
    turns, ends = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    rows, deepest = turns.agg(F.count("*"), F.coalesce(F.max("p"), F.lit(0))).first()
    most = max(heavy, rows // MOST_SPINE)
    spine = stored(turns.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("k1", "k2", F.lit(True).alias("_spine")))
    in_band = F.floor((F.col("p") - 1) / band)
    # at most rows / most nodes have more than `most` members, so the spine can be broadcast
    x = turns.join(F.broadcast(spine), ["k1", "k2"], "left").withColumn("_band", in_band)
    top = F.min(F.when(F.col("_spine").isNull(), F.struct("p", "k1", "k2"))).over(W.partitionBy("c", "_band"))
    shards = max(SHARDS, rows // SHARD_NODES)
    x = x.withColumn("_top", F.when(F.col("_spine").isNull(), top)).withColumn("shard", F.pmod(F.xxhash64("_top.k1", "_top.k2"), F.lit(shards)).cast("int")).drop("_top")
    nodes = stored(x.groupBy("k1", "k2").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("bytes").alias("bytes"),
        F.max("_spine").alias("_spine"), F.min("shard").alias("shard"), F.min("_band").alias("_band"),
    ))
    pieces, up, hanging = [], None, None
    for b in range(int((deepest - 1) // band), -1, -1):
        these = nodes.filter(F.col("_spine").isNull() & (F.col("_band") == b))
        done = stored(_with_extras(these, up).groupBy("shard").applyInPandas(lambda t: encoded(t), _OUT))
        pieces.append(done)
        roots = done.filter("parent_conv_id is null").select("k1", "k2", "q1", "q2", "n_leaves", "saved_tokens")
        up = roots.filter(F.col("q1").isNotNull())
        hanging = roots if hanging is None else hanging.unionByName(roots)
    root = ends.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    top_node = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("q1"), zero.alias("q2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"))
    held = nodes.filter("_spine").select("k1", "k2", "q1", "q2", "conv_id", "depth", "n_convs", "bytes").unionByName(top_node)
    trunk = stored(_with_extras(held, hanging).groupBy(F.lit(0).alias("shard")).applyInPandas(lambda t: encoded(t), _OUT))
    # roots of pieces find their parent's conversation in the trunk, or in the band above
    every = trunk
    for p in pieces:
        every = every.unionByName(p)
    mothers = trunk.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("_mother"))
    out = every.join(F.broadcast(mothers), ["q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_mother")).drop("_mother")
    if len(pieces) > 1:
        lone = out.filter("parent_conv_id is null").join(nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("_mother")), ["q1", "q2"])
        out = out.filter("parent_conv_id is not null").unionByName(lone.withColumn("parent_conv_id", F.col("_mother")).drop("_mother"))
    out = out.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    out = out.join(end_hashes(ends), ["k1", "k2"], "left")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select(*[F.col(c).cast("long").alias(c) for c in names], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; odd rows as in trie()."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_STEPS = ", ".join(["-1"] * 8)
#: crc32 bit by bit: a number 0 or more is a byte that comes in, -1 is one step. Turns with equal numbers go by role and text.
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), {_STEPS}])),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
facts AS (SELECT c, h, c - c % 5 AS base, least(h, (SELECT count(*) FROM t WHERE t.c = heads.c - heads.c % 5)) AS head FROM heads),
turns AS (SELECT c, head + r - h AS p, role, text FROM t JOIN facts USING (c) WHERE r > h UNION ALL SELECT facts.c, r, role, text FROM facts JOIN t ON t.c = base AND r <= h),
named AS (SELECT c, p, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY p)) AS k, strlen(text) AS bytes FROM turns UNION ALL SELECT c, 0, 'root', 0 FROM facts),
nodes AS (SELECT p, k, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM named GROUP BY 1, 2),
kin AS (SELECT nodes.*, m.k AS mother, a.conv_id AS parent_conv_id FROM nodes LEFT JOIN named m ON m.c = nodes.conv_id AND m.p = nodes.p - 1 LEFT JOIN nodes a ON a.p = m.p AND a.k = m.k),
kids AS (SELECT mother AS k, count(*) AS n_children FROM kin WHERE mother IS NOT NULL GROUP BY 1),
sums AS (SELECT a.p, a.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved_tokens FROM nodes v JOIN named a ON a.c = v.conv_id AND a.p <= v.p LEFT JOIN kids ON kids.k = v.k GROUP BY 1, 2),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, arg_max(k, p) AS k FROM named GROUP BY 1) GROUP BY 1)
SELECT conv_id, CAST(p AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, '{EMPTY}') AS ends_sha256
FROM kin LEFT JOIN kids USING (k) JOIN sums USING (p, k) LEFT JOIN ends USING (k)"""
