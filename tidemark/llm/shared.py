"""What the corpus operators share: the shared folder, range buckets over a global order, the tokenizer cache."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Key that stands for a null doc_id where a total order is needed; nulls come first.
NULL_KEY = -(2**63)


def scratch(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir; a temporary folder stands in only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there and no task repeats the work above."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() frame that nothing needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def order_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def range_buckets(df: DataFrame, key: str, rows_per_bucket: int, most: int = 20_000) -> tuple[DataFrame, list[int]]:
    """Add `bucket`: consecutive ranges of the long column `key`, about rows_per_bucket rows each.

    Only the bucket starts (at most `most`) come to the driver. Returns the frame and the smallest key of each
    bucket, in order; equal keys always share a bucket.
    """
    from pyspark.ml.feature import Bucketizer

    n = df.select(key).count()
    buckets = max(1, min(most, n // rows_per_bucket))
    starts: list[float] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        got = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), max(10_000, 4 * buckets)).alias("q")).first()["q"]
        starts = sorted({float(x) for x in got or []})
    if starts:
        cut = Bucketizer(splits=[-float("inf"), *starts, float("inf")], inputCol="_at", outputCol="_bucket")
        df = cut.transform(df.withColumn("_at", F.col(key).cast("double"))).withColumn("bucket", F.col("_bucket").cast("int")).drop("_at", "_bucket")
    else:
        df = df.withColumn("bucket", F.lit(0))
    first = {r["bucket"]: r["k"] for r in df.groupBy("bucket").agg(F.min(key).alias("k")).collect()}
    used = sorted(first)
    if used != list(range(len(used))):
        df = df.withColumn("bucket", F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(used) for x in (b, i)]), F.col("bucket")))
    return df, [first[b] for b in used]


#: Rows that Spark sends to a Python worker at a time: whole texts are long, and each worker and JVM holds several batches.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send at most `rows` rows at a time to Python workers from now on, if the session sends more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Hand freed memory of this process back to the system: workers are used again for other work, and keep it otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run as a function for mapInArrow that gives memory back when a task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            clear_words()
            give_back()

    return wrapped


SIEVE = 1 << 21


class Sieve:
    """Hash buckets of a set of long keys: rows in no such bucket are surely not among them, and need not meet them in a
    shuffle. There are SIEVE buckets at any size, which bounds what is broadcast; with very many keys fewer rows are held
    back, and a join behind it gives the same rows."""

    def __init__(self, keys: DataFrame):
        self.buckets = stored(keys.select(self._bucket(F.col(keys.columns[0])).alias("_sieve")).distinct())

    @staticmethod
    def _bucket(key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(SIEVE)).cast("int")

    def rows(self, df: DataFrame, key: str, among: bool = True) -> DataFrame:
        """Rows of df whose long column `key` may be among the keys, or those that surely are not. Null keys are neither."""
        kind = "left_semi" if among else "left_anti"
        return df.filter(df[key].isNotNull()).join(F.broadcast(self.buckets), self._bucket(df[key]) == self.buckets["_sieve"], kind)


_CONTROLS = "[\x1c-\x1f]"
_SEGMENT = 1 << 20
#: Bytes of text that are split into words at a time, and bytes of word parts and ids that the cache holds about.
_CHUNK, _CACHE = 1 << 20, 24 << 20
#: Letters up to U+024F but the dotted capital I, whose lower case is two characters; then any marks.
_PARTS = r"^(?P<letters>[A-Za-z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


class Encoder:
    """Encode texts word by word, with a bounded cache of the ids of words.

    The tokenizers used here drop white space and never join pieces across it, so the ids of a text are those of its
    white-space separated words, one after the other. Texts with the four control characters that Python and Arrow split
    at but the tokenizer does not are encoded whole.

    Words of Latin letters with ASCII marks behind them are two parts, the letters in lower case, where the tokenizer
    marks word ends: it does the same, and far fewer parts than words are new. Any other word is one part.
    """

    def __init__(self, path: str, most_bytes: int = _CACHE, chunk: int = _CHUNK):
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.chunk = Tokenizer.from_file(path), most_bytes, chunk
        self.parts, self.held = {}, 0
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = None  # by id: whether it ends a word, where the vocabulary marks that
        if any(n.endswith("</w>") for n in names):
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for n, i in names.items() if n.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_alone(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            for p, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[p] = array("I", got.ids).tobytes()

    def _learn_runs(self, parts: list[str]) -> None:
        """Parts that are letters or marks only end in exactly one id with a word end; 64 of them are encoded as one text."""
        import numpy as np

        runs = [parts[at : at + 64] for at in range(0, len(parts), 64)]
        for at in range(0, len(runs), 64):
            some = runs[at : at + 64]
            for run, got in zip(some, self.tokenizer.encode_batch_fast([" ".join(r) for r in some], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, dtype="<u4")
                stop = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stop) != len(run) or stop[-1] != len(ids):
                    self._learn_alone(run)
                    continue
                data = ids.tobytes()
                self.parts.update({p: data[4 * a : 4 * b] for p, a, b in zip(run, [0, *stop], stop, strict=False)})

    def _known(self, parts: list[str], runs: list[bool]) -> list[bytes]:
        """Ids of distinct parts. runs: which of them are letters only or marks only."""
        known = self.parts
        new = [(p, r) for p, r in zip(parts, runs, strict=True) if p not in known]
        if new and self.held > self.most:
            known.clear()
            self.held, new = 0, list(zip(parts, runs, strict=True))
        self._learn_runs([p for p, r in new if r and p])
        self._learn_alone([p for p, r in new if not r])
        known[""] = b""
        self.held += sum(200 + 3 * len(p) for p, _ in new)  # an entry takes some 200 bytes besides its part and ids
        return [known[p] for p in parts]

    def segment(self, text: str) -> bytes:
        import pyarrow as pa

        return self._whole(text) if re.search(_CONTROLS, text) else self._run(pa.array([text]))[0].tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        if len(text) <= _SEGMENT:
            return self.segment(text)
        return b"".join(self.segment(x) for x in segments(text))

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of the texts, in order: how many texts, their ids one after the other, and where each text's ids end.
        Each run's words are looked up once; very long texts and those with control characters are runs by themselves."""
        import numpy as np
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        alone = np.flatnonzero((np.diff(size) > _SEGMENT) | pc.match_substring_regex(texts, _CONTROLS).to_numpy(zero_copy_only=False))
        at, n = 0, len(texts)
        stops = [*alone.tolist(), n]
        for stop in stops:
            while at < stop:
                end = min(stop, max(at + 1, int(np.searchsorted(size, size[at] + self.chunk, "right")) - 1))
                yield end - at, *self._run(texts.slice(at, end - at))
                at = end
            if at < n:
                ids = np.frombuffer(self.ids(texts[at].as_py()), "<u4")
                yield 1, ids, np.asarray([len(ids)])
                at += 1

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.utf8_split_whitespace(texts)  # at the same characters as str.split, with empty words at the ends
        words = split.flatten().dictionary_encode()
        distinct, code = words.dictionary, words.indices.to_numpy()
        n = len(distinct)
        whole, both = np.ones(n, bool), distinct
        if self.ends is not None:
            two = pc.extract_regex(distinct, _PARTS)
            whole = pc.is_null(two).to_numpy(zero_copy_only=False)
            letters, marks = (pc.struct_field(two, k) for k in ("letters", "marks"))
            both = pa.concat_arrays([pc.coalesce(pc.utf8_lower(letters), distinct), marks.fill_null("")])
        parts = both.dictionary_encode()
        place = parts.indices.to_numpy()
        runs = np.ones(len(parts.dictionary), bool)
        runs[place[:n][whole]] = False
        data = self._known(parts.dictionary.to_pylist(), runs.tolist())
        each = np.asarray([len(x) for x in data], np.int64) // 4
        flat, start = np.frombuffer(b"".join(data), "<u4"), np.cumsum(each) - each
        if len(place) > n:  # each word is its letters' ids and its marks' ids
            code = np.stack([place[:n][code], place[n:][code]], 1).ravel()
        else:
            code = place[code]
        length = each[code]
        end = np.cumsum(length)
        took = np.arange(end[-1] if len(end) else 0) + np.repeat(start[code] - end + length, length)
        last = (split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py())[1:]
        return flat[took], np.concatenate([[0], end])[last * (2 if len(place) > n else 1)]


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """Parts of a very long text, cut only at plain spaces or line ends."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = re.compile("[ \n]").search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str, scale: int = 1) -> Encoder:
    """One per Python worker, vocabulary file and scale of its cache and runs."""
    key = f"{scale} {path}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, scale * _CACHE, scale * _CHUNK)
    return _encoders[key]


def clear_words() -> None:
    """Forget the ids of words: the next task of this worker may be of another kind, and need the room."""
    for e in _encoders.values():
        e.parts.clear()
        e.held = 0


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
