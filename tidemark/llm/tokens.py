"""Token counts and token-id files.

Lengths come from encoding whole texts. The length histogram answers totals, quantiles and truncated totals for every
context limit by suffix sums. The file format keeps raw ids in shards of consecutive doc_ids and finds a document by a
minimal perfect hash over the shard's keys.
"""

from __future__ import annotations

import json
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import NULL_KEY, crc, documents, encoder, lean, order_key, range_buckets, scratch, small_batches, stored

BAND = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- lengths


def lengths(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """(length, documents): how many documents have each encoded length. Tasks count before anything is shuffled.
    Null and empty texts have length `end` (the number of end tokens counted)."""

    small_batches(docs.sparkSession, 1000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer, 2), Counter()
        for b in batches:
            for _, _, ends in enc.batches(b.column(0)):
                n, times = np.unique(np.diff(ends, prepend=0) + end, return_counts=True)
                for length, k in zip(n.tolist(), times.tolist(), strict=True):
                    seen[length] += k
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "documents": pa.array(list(seen.values()), pa.int64())})

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "length long, documents long").groupBy("length").agg(F.sum("documents").alias("documents"))


def histogram(counts: DataFrame) -> DataFrame:
    """Answers for every length that occurs, taken as a context limit.

    documents: of that length; documents_from: of that length or more; tokens_upto: in documents up to that length;
    truncated_tokens: left when each document is cut at that length; quantile: share of documents up to that length.
    Sums run in bands of 4096 lengths, and over the totals of the bands.
    """
    banded = counts.withColumn("band", F.floor(F.col("length") / BAND))
    tokens = F.col("length") * F.col("documents")
    totals = banded.groupBy("band").agg(F.sum("documents").alias("_d"), F.sum(tokens).alias("_t"))
    up = W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("band", F.coalesce(F.sum("_d").over(up), F.lit(0)).alias("_db"), F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_tb"), F.sum("_d").over(W.partitionBy(F.lit(1))).alias("_all"))
    inner = W.partitionBy("band").orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    out = banded.withColumn("_du", F.sum("documents").over(inner)).withColumn("_tu", F.sum(tokens).over(inner)).join(totals, "band")
    du, tu = F.col("_db") + F.col("_du"), F.col("_tb") + F.col("_tu")
    return out.select(
        "length", "documents", (F.col("_all") - du + F.col("documents")).alias("documents_from"), tu.alias("tokens_upto"),
        (tu + (F.col("_all") - du) * F.col("length")).alias("truncated_tokens"), (du / F.col("_all")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left when documents are cut at each limit, whether or not that length occurs. Limits are a short list."""
    spark = hist.sparkSession
    want = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    at = F.broadcast(want).join(hist, F.col("length") <= F.col("context_limit"), "left")
    at = at.groupBy("context_limit").agg(F.max_by(F.struct("tokens_upto", "documents_from", "documents"), "length").alias("x"))
    everything = hist.agg(F.max("documents_from").alias("n"))
    above = F.coalesce(F.col("x.documents_from") - F.col("x.documents"), F.col("n"), F.lit(0))
    return at.crossJoin(everything).select("context_limit", (F.coalesce(F.col("x.tokens_upto"), F.lit(0)) + above * F.col("context_limit")).alias("tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents, each with one end token.

    Null and empty texts have length 1; repeated rows count each; ids and other columns are not read. An empty table gives
    no rows.
    """
    return histogram(stored(lengths(documents(spark, sf_dir), default_tokenizer(), end=1)))


# ---------------------------------------------------------------- minimal perfect hash

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def scramble(keys: np.ndarray, seed: int) -> np.ndarray:
    """Mix int64 keys to uint64 with a seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * _GOLD & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct int64 keys to 0..n-1 by levels of bit sets: a key stays on the first level where it is alone in its
    cell, and its slot is the number of set cells before it. About three bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            cells = max(64, int(room * len(left)))
            at = (scramble(left, len(levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has a set cell for it. Unknown keys may get a slot: compare fingerprints."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (scramble(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out


# ---------------------------------------------------------------- files

MAGIC = b"TKIX0001"


def index_bytes(keys: list[int], offsets: list[int], width: int) -> bytes:
    """Index of one shard. keys: of its documents in order, equal ones side by side; offsets: first id of each, and the end.

    After the magic and a JSON head: offsets (u64), the level bit sets, then for each slot the key's fingerprint (u32),
    the ordinal of its first document (u32) and the number of its documents (u32).
    """
    distinct, first, count = np.unique(np.asarray(keys, np.int64), return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    table = np.zeros((len(distinct), 3), "<u4")
    table[slot, 0] = (scramble(distinct, 99) >> np.uint64(32)).astype("<u4")
    table[slot, 1], table[slot, 2] = first, count
    head = json.dumps({"documents": len(keys), "keys": len(distinct), "width": width, "levels": [len(x) for x in mph.levels]}).encode()
    bits = [np.packbits(x.astype(np.uint8)).tobytes() for x in mph.levels]
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, np.asarray(offsets, "<u8").tobytes(), *bits, table.tobytes()])


class ShardIndex:
    def __init__(self, data: bytes):
        assert data[:8] == MAGIC, "not a token index"
        (n,) = struct.unpack_from("<I", data, 8)
        head, at = json.loads(data[12 : 12 + n]), 12 + n
        self.width = head["width"]
        self.offsets = np.frombuffer(data, "<u8", head["documents"] + 1, at).astype(np.int64)
        at += 8 * (head["documents"] + 1)
        levels = []
        for cells in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (cells + 7) // 8, at))[:cells].astype(np.int64))
            at += (cells + 7) // 8
        self.mph = PerfectHash(levels)
        self.table = np.frombuffer(data, "<u4", 3 * head["keys"], at).reshape(-1, 3)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first ordinal, count) of each key; count 0 for a key that the shard does not hold."""
        slot = self.mph.slots(keys)
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        row = self.table[np.maximum(slot, 0)]
        known = (slot >= 0) & (row[:, 0] == (scramble(keys, 99) >> np.uint64(32)).astype("<u4"))
        return np.where(known, row[:, 1], 0).astype(np.int64), np.where(known, row[:, 2], 0).astype(np.int64)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, rows_per_shard: int = 2000) -> DataFrame:
    """Encode every document, append end_id and write shards of consecutive doc_ids into a shared folder.

    One shuffle brings each id range to one task, which streams its sorted rows into `shard-N.bin` (ids of two bytes if
    all fit, else four) and then writes `shard-N.idx`. Files are renamed when complete, so a repeated task replaces its
    own work. Null ids come first, under a reserved key; equal ids keep the order of their texts. Returns the manifest,
    (shard, documents, tokens, base): base counts the ids of all shards before.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    slim = docs.select(order_key().alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, starts = range_buckets(slim, "_key", rows_per_shard)
    from tokenizers import Tokenizer

    top_id = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = 2 if top_id <= 2**16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, (out, top) = encoder(tokenizer, 2), _files(folder)
        shard, sink, keys, offsets, done = None, None, [], [0], []
        name = uuid.uuid4().hex

        def close() -> None:
            sink.close()
            with out.open_output_stream(f"{top}/{name}.idx") as f:
                f.write(index_bytes(keys, offsets, width))
            for kind in ("bin", "idx"):
                out.move(f"{top}/{name}.{kind}", f"{top}/shard-{shard:08d}.{kind}")
            done.append((shard, len(keys), offsets[-1]))

        for b in batches:
            shards, names, row = b.column(0).to_numpy(), b.column(1).to_numpy(), 0
            for n, ids, ends in enc.batches(b.column(2)):
                flat = np.insert(ids.astype(f"<u{width}"), ends, end_id)  # behind each document's ids
                ends = ends + np.arange(1, n + 1)
                edges = np.flatnonzero(np.diff(shards[row : row + n])) + 1
                for a, z in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                    if shards[row + a] != shard:
                        if sink:
                            close()
                        shard, keys, offsets, name = int(shards[row + a]), [], [0], uuid.uuid4().hex
                        sink = out.open_output_stream(f"{top}/{name}.bin")
                    first = int(ends[a - 1]) if a else 0
                    sink.write(flat[first : int(ends[z - 1])].tobytes())
                    keys.extend(names[row + a : row + z].tolist())
                    base = offsets[-1] - first
                    offsets.extend((ends[a:z] + base).tolist())
                row += n
        if sink:
            close()
        yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in done], pa.int64()) for i, k in enumerate(("shard", "documents", "tokens"))})

    out, top = _files(folder)
    out.create_dir(top, recursive=True)
    spread = dealt.select(F.col("bucket").alias("shard"), "_key", "text").repartition("shard").sortWithinPartitions("shard", "_key", "text")
    manifest = stored(spread.mapInArrow(lean(write), "shard long, documents long, tokens long"))
    rows, base = sorted((r["shard"], r["documents"], r["tokens"]) for r in manifest.collect()), 0
    table = []
    for shard, n, tokens in rows:  # one row for each shard
        table.append((shard, n, tokens, base, starts[shard] if starts else NULL_KEY))
        base += tokens
    return spark.createDataFrame(table, "shard long, documents long, tokens long, base long, first_key long")


def lookup_tasks(spark: SparkSession, shards: int | None) -> int:
    """Tasks read whole payloads for a few bytes of keys, so their number follows the shards, not the size of the keys."""
    return max(1, min(shards, 100_000)) if shards else int(spark.conf.get("spark.sql.shuffle.partitions"))


def payload_rows(payload: pa.NativeFile, index: ShardIndex, at: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """The ordinals of documents with their ids as little-endian unsigned 32-bit integers. Neighbours are read at once,
    up to `most` bytes or one document."""
    lo, hi = index.offsets[at] * index.width, index.offsets[at + 1] * index.width
    a = 0
    while a < len(at):
        z = a + 1
        while z < len(at) and lo[z] == hi[z - 1] and hi[z] - lo[a] <= most:
            z += 1
        payload.seek(int(lo[a]))
        data = np.frombuffer(payload.read(int(hi[z - 1] - lo[a])), f"<u{index.width}").astype("<u4").tobytes()
        for k in range(a, z):
            x, y = (int(v - lo[a]) // index.width * 4 for v in (lo[k], hi[k]))
            yield int(at[k]), data[x:y]
        a = z


def read_keys(keys: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """Look keys up: (shard, key, ordinal, local_start, n_tokens, ids_crc32), one row per document of each (shard, key) row.

    Each task opens the index of a shard, hashes its keys to slots, compares fingerprints and reads just those ids.
    """
    schema = "shard long, key long, ordinal long, local_start long, n_tokens long, ids_crc32 long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, top = _files(folder)
        shard, index, payload = None, None, None
        for b in batches:
            shards, want = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for s in dict.fromkeys(shards.tolist()):
                mine = want[shards == s]
                if s != shard:
                    shard = s
                    with out.open_input_file(f"{top}/shard-{s:08d}.idx") as f:
                        index = ShardIndex(f.read())
                    payload = out.open_input_file(f"{top}/shard-{s:08d}.bin")
                first, count = index.find(mine)
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())  # ordinals of all documents found
                for i, ids in payload_rows(payload, index, at):
                    rows["ordinal"].append(i)
                    rows["ids_crc32"].append(crc(ids))
                rows["shard"] += [s] * len(at)
                rows["key"] += np.repeat(mine, count).tolist()
                rows["local_start"] += index.offsets[at].tolist()
                rows["n_tokens"] += (index.offsets[at + 1] - index.offsets[at]).tolist()
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    slim = keys.select(F.col("shard").cast("long"), F.col("key").cast("long"))
    return slim.repartition(lookup_tasks(slim.sparkSession, shards), "shard").sortWithinPartitions("shard", "key").mapInArrow(lean(look), schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back; odd rows as in file_digest()."""
    return file_digest(documents(spark, sf_dir), default_tokenizer(), 2)


def file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to token files, look every doc_id up again and digest what the files hold.

    Null and empty texts are the end id alone. Null ids come first; rows of one id follow one another in the files and are
    each given back. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    manifest = write_shards(docs, folder, tokenizer, end_id)
    # the same ranges as in the files: each key goes to the last shard whose first key is not above it

    keys = docs.select(order_key().alias("key")).distinct()
    firsts = [(r["first_key"], r["shard"]) for r in manifest.select("first_key", "shard").collect()]
    keys = _to_shard(keys, firsts)
    found = read_keys(keys, folder, len(firsts))
    return found.join(manifest, "shard").select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def _to_shard(keys: DataFrame, firsts: list[tuple[int, int]]) -> DataFrame:
    """Shard of each key by binary search over the first keys, in batches."""
    edges = np.asarray([k for k, _ in sorted(firsts)], np.int64)
    names = np.asarray([s for _, s in sorted(firsts)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"shard": pa.array(names[np.searchsorted(edges, key, "right") - 1], pa.int64()), "key": pa.array(key, pa.int64())})

    return keys.mapInArrow(place, "shard long, key long")
