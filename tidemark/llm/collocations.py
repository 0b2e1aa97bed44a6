"""Phrases that stand out in each language, counted over a prefix-free parse.

A text becomes pieces (runs between stops) of words. Words whose hash triggers end a chunk, so equal passages fall into equal
chunks wherever they stand. A chunk holds its core words and the words behind them, in the same piece, that a phrase which
starts in the core can still reach. Distinct chunks with how often they were parsed are the dictionary; phrases are counted
in it once per distinct chunk, weighed, and only from core words on, so what two chunks share is counted in one of them.

Pairs are counted only where both words have the least count, longer phrases only where all pairs inside have it, as they
must. That is asked of a bitmap of fixed size, broadcast at any size of the corpus: a full one lets more pass, and never a phrase too few.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, forget, lean, scratch, small_batches

LONGEST, LEAST, SHARE, FIRST = 4, 30, 80, 2000
#: One word in TRIGGER ends a chunk; a core has at most MOST_CORE words.
TRIGGER, MOST_CORE = 16, 256
#: Bits of the bitmap of frequent phrases (4 MB), and words that a task counts at a time.
BITS, WORDS_AT_ONCE, BYTES_AT_ONCE = 25, 2_000_000, 32 << 20
#: Rows that look up one word are dealt to so many copies of it.
SALTS = 16
_STOPS = ".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]], _KIND[[ord(c) for c in _STOPS]] = 1, 2


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- the parse --------------------------------------------------------------------------------------------------------


def _spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `lengths` of them, one span after the other."""
    end = np.cumsum(lengths)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - lengths - starts, lengths)


def parse(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, core words of each, text of each). Words of a chunk are joined by spaces; a word that begins a piece has a
    line end before it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    word, edge = kind == 0, np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(start)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    stops = np.cumsum(kind == 2)[start]
    begins = np.ones(n, bool)
    begins[1:] = (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])
    small = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)[word]
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(small)])
    coded = words.dictionary_encode()
    ends_chunk = np.asarray([zlib.crc32(w.encode()) % TRIGGER == 0 for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    opens = np.ones(n, bool)
    opens[1:] = ends_chunk[:-1] | (text[1:] != text[:-1])
    at = np.arange(n)
    opens |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % MOST_CORE == 0
    head = np.flatnonzero(opens)
    core = np.diff(np.append(head, n))
    piece_ends = np.append(np.flatnonzero(begins)[1:], n)  # where the piece of each word ends, by piece
    reach = np.minimum(head + core + LONGEST - 1, piece_ends[(np.cumsum(begins) - 1)[head + core - 1]])
    size = reach - head
    marked = pc.binary_join_element_wise(pa.array(np.where(begins, "\n", "")), words, "")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), marked.take(pa.array(_spans(size, head))))
    return pc.binary_join(lists, " "), core, text[head]


def _short(text: str | None, most: int) -> list[str]:
    """Parts of a text, cut only behind stops."""
    parts, at = [], 0
    text = text or ""
    while len(text) - at > most:
        found = re.compile("[.,;:!?\n\x0b\x0c\r]").search(text, at + most)
        end = found.end() if found else len(text)
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]] if at < len(text) or not parts else parts


def chunks(docs: DataFrame) -> DataFrame:
    """(lang, core, chunk, times): the dictionary of distinct chunks with how often each was parsed."""

    def part(texts: pa.Array, langs: pa.Array) -> pa.RecordBatch:
        chunk, core, text = parse(texts)
        t = pa.table({"lang": langs.take(pa.array(text)), "core": pa.array(core, pa.int64()), "chunk": chunk}).group_by(["lang", "core", "chunk"]).aggregate([([], "count_all")])
        return pa.RecordBatch.from_pydict({"lang": t["lang"].combine_chunks(), "core": t["core"].combine_chunks(), "chunk": t["chunk"].combine_chunks(), "times": t["count_all"].combine_chunks()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 4 << 20
        for b in batches:
            texts, langs = b.column(0).fill_null(""), b.column(1)
            size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
                if size[to] - size[at] > most:  # one text by itself
                    for x in _short(texts[at].as_py(), most):
                        yield part(pa.array([x]), langs.slice(at, 1))
                else:
                    yield part(texts.slice(at, to - at), langs.slice(at, to - at))
                at = to

    small_batches(docs.sparkSession)
    x = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))).mapInArrow(lean(run), "lang string, core long, chunk string, times long")
    return x.groupBy("lang", "core", "chunk").agg(F.sum("times").alias("times"))


# --- counts -----------------------------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)


def _bit(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)


def _distinct(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One number for each distinct row of columns, given with the number of values each can take."""
    key, room = np.zeros(len(columns[0][0]), np.int64), 1
    for values, size in columns:
        if room * size >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            room = int(key.max()) + 1 if len(key) else 1
        key, room = key * size + values, room * size
    return key


def _count(rows: list[pa.RecordBatch], lengths: tuple[int, ...], frequent: np.ndarray | None, inner: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, times) of phrases of some lengths in some rows of the dictionary, one batch a length.

    frequent: bits of the phrases of `inner` words that have the least count."""
    t = pa.Table.from_batches(rows).combine_chunks()
    lang, core, chunk, times = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
    split = pc.split_pattern(chunk, " ")
    size = np.diff(split.offsets.to_numpy())
    marked = split.flatten().dictionary_encode()
    names = pc.ascii_ltrim(marked.dictionary, "\n").dictionary_encode()
    words, at = names.dictionary, marked.indices.to_numpy()
    code = names.indices.to_numpy()[at].astype(np.int64)
    total, first = len(code), np.cumsum(size) - size
    begins = pc.starts_with(marked.dictionary, "\n").to_numpy(zero_copy_only=False)[at]
    begins[first] = True
    piece, row = np.cumsum(begins), np.repeat(np.arange(len(size)), size)
    inside = np.arange(total) - first[row] < core.to_numpy()[row]
    tongue = lang.dictionary_encode()
    langs, tongues = tongue.indices.to_numpy()[row].astype(np.int64), tongue.dictionary
    seen = None
    if frequent is not None:
        h = _hashes(words)[code]
        run = _hashes(tongues)[langs] * _MIX + h
        for k in range(1, inner):
            run = run * _MIX + np.append(h[k:], np.zeros(k, np.uint64))
        seen = np.unpackbits(frequent, bitorder="little")[_bit(run).astype(np.int64)].astype(bool)
    for n in lengths:
        starts = np.arange(max(total - n + 1, 0))
        ok = inside[starts] & (piece[starts] == piece[starts + n - 1])
        for k in range(n - inner + 1 if seen is not None else 0):
            ok &= seen[starts + k]
        starts = starts[ok]
        key = _distinct([(langs[starts], len(tongues)), *[(code[starts + k], max(len(words), 1)) for k in range(n)]])
        _, where, same = np.unique(key, return_index=True, return_inverse=True)
        found = np.zeros(len(where), np.int64)
        np.add.at(found, same, times.to_numpy()[row[starts]])
        one = starts[where]
        taken = [words.take(pa.array(code[one + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*taken, " ") if n > 1 else taken[0]
        yield pa.RecordBatch.from_pydict({"lang": tongues.take(pa.array(langs[one])), "phrase": phrase, "times": found})


def counts(dictionary: DataFrame, lengths: tuple[int, ...], least: int, frequent: np.ndarray | None = None, inner: int = 0) -> DataFrame:
    """(lang, phrase, f) of the phrases of some lengths that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            words, size = words + pc.sum(b.column(1)).as_py() + LONGEST * b.num_rows, size + b.column(2).nbytes
            if words >= WORDS_AT_ONCE or size >= BYTES_AT_ONCE:
                yield from _count(held, lengths, frequent, inner)
                held, words, size = [], 0, 0
        if held:
            yield from _count(held, lengths, frequent, inner)

    x = dictionary.select("lang", "core", "chunk", "times").mapInArrow(lean(run), "lang string, phrase string, times long")
    return x.groupBy("lang", "phrase").agg(F.sum("times").alias("f")).filter(F.col("f") >= least)


def bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all phrases of `found`, all of one length; its size does not depend on their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = pc.split_pattern(b.column(1), " ")
            words = _hashes(lists.flatten()).reshape(b.num_rows, -1)
            h = _hashes(b.column(0))
            for k in range(words.shape[1]):
                h = h * _MIX + words[:, k]
            yield pa.RecordBatch.from_pydict({"at": _bit(h).astype(np.int64) + 1})

    at = found.select("lang", "phrase").mapInArrow(run, "at long")
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for p in parts:
        out[(p["part"] - 1) * 4096 : p["part"] * 4096] = np.frombuffer(p["bits"], np.uint8)
    return out


# --- scores -----------------------------------------------------------------------------------------------------------


def _phrase(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates at their lowest cut. counted: (lang, phrase, f) of all lengths.

    A word stands in many cuts, so words are looked up in SALTS copies. Spark sizes those as the stored table, which is packed
    and has one copy, so it is told not to broadcast them."""
    c = counted.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    cuts = c.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    salt = lambda length: F.when(length == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    cuts = cuts.select("*", _phrase(F.col("words"), 1, F.col("k")).alias("_first"), _phrase(F.col("words"), F.col("k") + 1, F.size("words")).alias("_rest"))
    cuts = cuts.withColumn("_s1", salt(F.col("k"))).withColumn("_s2", salt(F.size("words") - F.col("k")))
    copies = F.explode(F.when(F.instr("phrase", " ") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    known = counted.select("lang", "phrase", "f", copies.alias("_s"))
    named = lambda p, s, f: known.select("lang", F.col("phrase").alias(p), F.col("_s").alias(s), F.col("f").alias(f)).hint("merge")
    cuts = cuts.join(named("_first", "_s1", "l"), ["lang", "_first", "_s1"]).join(named("_rest", "_s2", "r"), ["lang", "_rest", "_s2"])
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    score = F.call_function("div", (exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(27,0)"), (exact("l") + exact("r")).cast("decimal(27,0)"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return lowest.select("lang", "phrase", F.split("phrase", " ").alias("words"), "a", "b.l", "b.r", "b.score")


def without_parts(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that no longer one holds with `share` percent of their count or more."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: _phrase(F.col("words"), i, n))))
    longer = candidates.filter(F.size("words") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("_a"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
    return candidates.join(longest.hint("merge"), ["lang", "phrase"], "left").filter(F.col("_a").isNull() | (F.col("_a") * 100 < F.col("a") * share)).drop("_a")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the `first` phrases of each language.

    Null and empty texts have no words, null languages are `und` (as are documents of that name), repeated rows count as
    often as they stand there, ids are not read, other columns neither. Ties go by count, then by the bytes of the phrase. An
    empty table gives an empty result. Texts of any length are parsed whole, very long ones in parts cut at stops.
    """
    dictionary = _kept(chunks(docs))
    words = dictionary.groupBy("lang").agg(F.sum(F.col("core") * F.col("times")).alias("n"))
    levels, frequent = [], None
    for inner, lengths in enumerate([(1,), (2,), tuple(range(3, LONGEST + 1))]):
        levels.append(_kept(counts(dictionary, lengths, least, frequent, inner)))
        if inner < 2:
            frequent = bitmap(levels[-1])
    counted = levels[0]
    for level in levels[1:]:
        counted = counted.unionByName(level)
    words = _kept(words)
    forget(dictionary)
    best = without_parts(scored(counted))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = best.withColumn("rank", rank).filter(F.col("rank") <= first)
    return top.join(F.broadcast(words) if words.count() < 100_000 else words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents; odd rows as in collocations()."""
    return collocations(documents(spark, sf_dir))


SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.*, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS a FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE inner_.a IS NULL OR 100 * inner_.a < {SHARE} * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= {FIRST}"""
