"""Brown class-based bigrams.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)). Words that occur at least twice get their class by
exchange, to the class with the largest gain in class-bigram likelihood: the 2048 most frequent one after the other, with all
other words as one; then all others in sweeps, each a job that weighs every word with all its neighbours against the counts
of class pairs of the sweep before. They start from the power of two of their count as class, and stay there if no move
gains. Words seen once share a class with unknown words. Counts cover all training documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_of_id, documents, forget, lean, stored

EXCHANGED, CLASSES, SWEEPS, BLOCK_ROWS, FLUSH = 2048, 64, 3, 2048, 200_000
REST_SWEEPS, BUCKET_WORDS, HEAD = 2, 1 << 16, 128
START, END, RARE = 0, 1, 2
BANDS = 40
FIRST = RARE + BANDS + 1
K = FIRST + CLASSES


def tokens(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z in lower case; bytes split at exactly the six ASCII blanks."""
    return (text or "").encode().lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all texts; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    return train.select("text").mapInArrow(lean(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def pair_counts(train: DataFrame, head: list[str]) -> np.ndarray:
    """Rows (a, b, n): how often head word b follows head word a, with START, END and all other words as len(head) and the next two."""
    index, n = {w.encode(): i for i, w in enumerate(head)}, len(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = n + 3
        total = np.zeros(side * side, np.int32)
        for b in batches:
            codes: list[int] = []
            for text in b.column(0):
                codes.append(n)
                codes += [index.get(w, n + 2) for w in tokens(text.as_py())]
                codes.append(n + 1)
                if len(codes) > 1_000_000:
                    _add_pairs(total, codes, side, n)
                    codes = []
            _add_pairs(total, codes, side, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = train.select("text").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell = rows.column("cell").to_numpy()
    return np.stack([cell // (n + 3), cell % (n + 3), rows.column("n").to_numpy()], 1).astype(np.int64)


def _add_pairs(total: np.ndarray, codes: list[int], side: int, n: int) -> None:
    x = np.asarray(codes, np.int64)
    a, b = x[:-1], x[1:]
    ok = a != n + 1
    at, more = np.unique(a[ok] * side + b[ok], return_counts=True)
    total[at] += more.astype(np.int32)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of `words` words. pairs: (a, b, n) with START = words, END = words + 1 and the other words =
    words + 2, which keep classes of their own. Words start in order of frequency, one after the other over the classes; each sweep takes every word
    out and puts it where likelihood gains most, ties to the smaller class."""
    size = classes + 3
    cls = np.concatenate([np.arange(words) % classes, [classes, classes + 1, classes + 2]])
    counts = np.zeros((size, size))
    np.add.at(counts, (cls[pairs[:, 0]], cls[pairs[:, 1]]), pairs[:, 2])
    by_a, by_b = pairs[np.argsort(pairs[:, 0], kind="stable")], pairs[np.argsort(pairs[:, 1], kind="stable")]
    to_a, to_b = np.searchsorted(by_a[:, 0], np.arange(words + 1)), np.searchsorted(by_b[:, 1], np.arange(words + 1))
    diag = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            nxt, prv = by_a[to_a[w] : to_a[w + 1], 1:], by_b[to_b[w] : to_b[w + 1]][:, [0, 2]]
            same = nxt[nxt[:, 0] == w, 1].sum()
            nxt, prv = nxt[nxt[:, 0] != w], prv[prv[:, 0] != w]
            r = np.bincount(cls[nxt[:, 0]], nxt[:, 1], size)
            left = np.bincount(cls[prv[:, 0]], prv[:, 1], size)
            k = cls[w]
            counts[k] -= r
            counts[:, k] -= left
            counts[k, k] -= same
            base = _f(counts)
            down, across = _f(counts + r) - base, _f(counts + left[:, None]) - base
            own = counts[diag, diag]
            gain = down.sum(1)[:classes] - down[diag, diag] + across.sum(0)[:classes] - across[diag, diag] + _f(own + r[:classes] + left[:classes] + same) - _f(own)
            rows, cols = counts.sum(1)[:classes], counts.sum(0)[:classes]
            gain -= _f(rows + r.sum() + same) - _f(rows) + _f(cols + left.sum() + same) - _f(cols)
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            cls[w] = best
            counts[best] += r
            counts[:, best] += left
            counts[best, best] += same
        if not moved:
            break
    return cls[:words]


def numbered(counts: DataFrame, train: DataFrame, train_docs: int) -> tuple[DataFrame, dict]:
    """(word, id, c, start) of every training word, and the totals; start is the class before the sweeps, with HEAD added for
    the words of the first exchange. Ids of words seen twice or more are dense, id mod buckets is a word's bucket; others have -1."""
    spark = counts.sparkSession
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = (sums["n"] or 0) + train_docs, sums["v"] + (train_docs > 0)
    top = counts.filter("c >= 2").orderBy(F.desc("c"), "word").limit(EXCHANGED).collect()
    head = [r["word"] for r in top]
    cls = exchange(pair_counts(train, head), len(head)) if head else np.empty(0, np.int64)
    chosen = spark.createDataFrame(pd.DataFrame({"word": head, "x": (FIRST + HEAD + cls).astype(int)}) if head else [], "word string, x int")
    buckets = max(32, -(-(sums["v"] - sums["n1"]) // BUCKET_WORDS))
    band = F.least(F.floor(F.log2("c")), F.lit(BANDS)).cast("int") + RARE
    often = counts.filter("c >= 2").join(F.broadcast(chosen), "word", "left").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("c"), "word")) - 1
    often = often.select("word", (place * buckets + F.col("bucket")).alias("id"), "c", F.coalesce("x", band).alias("start"))
    words = stored(often.unionByName(counts.filter("c = 1").select("word", F.lit(-1).alias("id"), "c", F.lit(RARE).alias("start"))))
    unknown = (sums["n1"] + 1) / (sums["n1"] + 2 * sums["n2"] + 2) if sums["n1"] else 1.0
    facts = {"n": n, "all": n + 0.1 * (v + 1), "unknown": unknown, "train_docs": train_docs, "buckets": buckets, "once": sums["n1"]}
    facts["head"] = [(FIRST + int(k), r["c"]) for k, r in zip(cls, top, strict=True)]
    return words, facts


def first_classes(words: DataFrame, buckets: int) -> np.ndarray:
    """The start of every id, one byte each, as the sweeps return it."""

    def gather(t: pa.Table) -> pa.Table:
        at = t.column("id").to_numpy() // buckets
        out = np.zeros(at.max() + 1, np.uint8)
        out[at] = t.column("start").to_numpy()
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "classes": pa.array([out.tobytes()])})

    x = words.filter("id >= 0").select("id", "start", (F.col("id") % buckets).cast("int").alias("bucket"))
    return _table(x.groupBy("bucket").applyInArrow(gather, "bucket int, classes binary").collect(), buckets)


def _table(rows: list, buckets: int) -> np.ndarray:
    """Classes by id of all words seen twice or more; ids -1 and -2, seen once and unknown, meet the two last ones."""
    most = max((len(r["classes"]) for r in rows), default=0)
    out = np.full((most, buckets), RARE, np.uint8)
    for r in rows:
        out[: len(r["classes"]), r["bucket"]] = np.frombuffer(r["classes"], np.uint8)
    return np.append(out.ravel(), np.array([RARE, RARE], np.uint8))


CODES = 2 * K + 1  # next classes, previous ones, the word itself next


def neighbours(rows: DataFrame, table, buckets: int) -> DataFrame:
    """(bucket, cells, n): how often each word outside the head has each class beside it; a cell is the word's place in
    its bucket times CODES plus the code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cls = table.value
            x = np.concatenate([v for i in ids for v in (np.array([-3], np.int32), i)] + [np.array([-3], np.int32)]).astype(np.int64)
            ids.clear()
            at = np.flatnonzero(x >= 0)
            at = at[cls[x[at]] < HEAD]
            w, prv, nxt = x[at], x[at - 1], x[at + 1]
            low = cls & (HEAD - 1)
            after, before = np.where(nxt == -3, END, low[nxt]), np.where(prv == -3, START, low[prv])
            self_next, self_prv = nxt == w, prv == w
            per = len(cls) // buckets + 1
            key = ((w % buckets) * per + w // buckets) * CODES
            cell, n = np.unique(np.concatenate([key + np.where(self_next, 2 * K, after), (key + K + before)[~self_prv]]), return_counts=True)
            ends = np.searchsorted(cell, np.arange(buckets + 1, dtype=np.int64) * per * CODES)
            use = [b for b in range(buckets) if ends[b] < ends[b + 1]]
            cells = [(cell[ends[b] : ends[b + 1]] - b * per * CODES).astype(np.int64).tobytes() for b in use]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(use, pa.int32()), "cells": pa.array(cells, pa.binary()), "n": pa.array([n[ends[b] : ends[b + 1]].astype(np.int32).tobytes() for b in use], pa.binary())})

        for b in batches:
            for x in b.column(0):
                ids.append(np.frombuffer(x.as_py(), np.int32))
                if len(ids[-1]) > 2_000_000:
                    yield flush()
            if sum(map(len, ids)) > 2_000_000:
                yield flush()
        if ids:
            yield flush()

    return rows.select("ids").mapInArrow(lean(count), "bucket int, cells binary, n binary")


def best_classes(cell: np.ndarray, n: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each word that gains most with all other words where they are; the word's own one if none gains.
    cell, n: sorted cells of words 0 to len(own) - 1 as in neighbours(), each once; counts: of class pairs."""
    words, code = len(own), cell % CODES
    w = cell // CODES
    dense = np.bincount(cell, n, words * CODES).reshape(words, CODES)
    r, left, same = dense[:, :K], dense[:, K : 2 * K], dense[:, 2 * K]
    classes = np.arange(FIRST, K)
    fc, i = _f(counts), np.arange(words)
    # what a new neighbour adds to a class: rows for next classes, then for previous ones
    base = np.concatenate([counts[FIRST:].T, counts[:, FIRST:]])
    f_base, small = _f(base), 16
    tables = np.stack([_f(base + k) - f_base for k in range(small + 1)])
    part = code < 2 * K
    wp, cp, np_ = w[part], code[part], n[part]
    gain = np.zeros((words, len(classes)))
    for s in range(0, len(wp), 200_000):
        a, c, m = wp[s : s + 200_000], cp[s : s + 200_000], np_[s : s + 200_000]
        add = tables[np.minimum(m, small), c]
        big = m > small
        add[big] = _f(base[c[big]] + m[big, None]) - f_base[c[big]]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        gain[a[starts]] += np.add.reduceat(add, starts)
    diag, rk, lk = fc[classes, classes], r[:, FIRST:], left[:, FIRST:]
    d = counts[classes, classes]
    gain += _f(d + rk + lk + same[:, None]) - diag - (_f(d + rk) - diag) - (_f(d + lk) - diag)
    to_own, from_own, ro, lo = counts[FIRST:][:, own].T, counts[own][:, FIRST:], r[i, own][:, None], left[i, own][:, None]
    gain += _f(to_own - lk + ro) - _f(to_own - lk) - (_f(to_own + ro) - _f(to_own))
    gain += _f(from_own - rk + lo) - _f(from_own - rk) - (_f(from_own + lo) - _f(from_own))
    total_r, total_l = r.sum(1) + same, left.sum(1) + same
    rows, cols = counts.sum(1), counts.sum(0)
    gain -= _f(rows[FIRST:] + total_r[:, None]) - _f(rows[FIRST:]) + _f(cols[FIRST:] + total_l[:, None]) - _f(cols[FIRST:])
    row, col = counts[own].copy(), counts[:, own].T.copy()
    stay = (_f(row) - _f(row - r)).sum(1) + (_f(col) - _f(col - left)).sum(1)
    oo = counts[own, own]
    stay += _f(oo) - _f(oo - r[i, own] - left[i, own] - same) - (_f(oo) - _f(oo - r[i, own])) - (_f(oo) - _f(oo - left[i, own]))
    stay -= _f(rows[own]) - _f(rows[own] - total_r) + _f(cols[own]) - _f(cols[own] - total_l)
    inside = own >= FIRST
    gain[i[inside], own[inside] - FIRST] = stay[inside]
    best = gain.argmax(1)
    return np.where(gain[i, best] > stay + 1e-9, FIRST + best, own)


def clustered(rows: DataFrame, words: DataFrame, facts: dict) -> tuple[np.ndarray, dict]:
    """Classes by id after the sweeps, and the totals with the mass of each class. rows: coded training documents.

    A sweep deals words to tasks by bucket, each with at most some 2^16 words. One byte a word comes to the driver and goes
    to all tasks.
    """
    spark, buckets = rows.sparkSession, facts["buckets"]
    table = first_classes(words, buckets)
    mass = np.zeros(K)
    for _ in range(REST_SWEEPS if len(table) > 2 else 0):
        sent, counts = spark.sparkContext.broadcast(table), transitions(rows, table)

        def move(t: pa.Table) -> pa.Table:  # runs within this turn of the loop
            b = t.column("bucket")[0].as_py()
            own = sent.value[:-2].reshape(-1, buckets)[:, b].copy()
            cells = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("cells")])
            cell, at = np.unique(cells, return_inverse=True)
            n = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in t.column("n")])).astype(np.int64)
            mass = np.zeros(K)
            for s in range(0, len(own), 2048):
                i, j = np.searchsorted(cell, [s * CODES, (s + 2048) * CODES])
                o = own[s : s + 2048]
                low = best_classes(cell[i:j] - s * CODES, n[i:j], o.astype(np.int64) & (HEAD - 1), counts)
                has = np.bincount((cell[i:j] // CODES) - s, n[i:j] * (cell[i:j] % CODES >= K), len(o))
                own[s : s + 2048] = np.where(has > 0, low, o)
                mass += np.bincount(low, has, K)
            return pa.table({"bucket": pa.array([b], pa.int32()), "classes": pa.array([own.tobytes()]), "mass": pa.array([mass.tolist()])})

        done = neighbours(rows, sent, buckets).groupBy("bucket").applyInArrow(move, "bucket int, classes binary, mass array<double>").collect()
        mass = np.sum([r["mass"] for r in done], 0) if done else mass
        old = table[:-2].reshape(-1, buckets).copy()
        for r in done:
            old[:, r["bucket"]] = np.frombuffer(r["classes"], np.uint8)
        table = np.append(old.ravel(), table[-2:])
    for k, c in facts["head"]:
        mass[k] += c
    mass[RARE] = facts["once"]
    return table & (HEAD - 1), facts | {"mass": np.where(mass > 0, mass, 1.0)}


def vocabulary(counts: DataFrame, train: DataFrame, train_docs: int) -> tuple[DataFrame, dict]:
    """(word, cls, c) of every training word, and the totals."""
    words, facts = numbered(counts, train, train_docs)
    rows = stored(coded(train.select("doc_id", "text", F.lit(False).alias("held_out")), words, facts))
    table, facts = clustered(rows, words, facts)
    sent = counts.sparkSession.sparkContext.broadcast(table)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value[b.column(1).to_numpy()].astype(np.int8)), b.column(2)], ["word", "cls", "c"])

    return words.select("word", "id", "c").mapInArrow(name, "word string, cls tinyint, c long"), facts


def class_logs(facts: dict) -> np.ndarray:
    """log10 of what a word's count is multiplied with in P(word | class)."""
    share = 1 / facts["mass"]
    share[RARE] *= 1 - facts["unknown"]
    return np.log10(np.maximum(share, 1e-300))


def word_logs(cls: np.ndarray, c: np.ndarray, facts: dict) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(word | class) and of the base probability; c is 0 for the unknown word."""
    return np.where(c == 0, np.log10(facts["unknown"]), np.log10(np.maximum(c, 1)) + class_logs(facts)[cls]), np.log10((c + 0.1) / facts["all"])


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, counts double, ids binary"


def coded(docs: DataFrame, vocab: DataFrame, facts: dict) -> DataFrame:
    """Each document's sums (of the base and of log10 of its words' counts) and the ids of its words.

    Documents are dealt into blocks of about 2048 by one shuffle; only the distinct words of a block meet the
    vocabulary, so neither the vocabulary nor the words of single documents are sent around.
    """
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    texts = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")).repartition("block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], set] = {}

        def flush() -> pa.RecordBatch:
            size = [len(x) for x in seen.values()]
            words = pa.array([w for x in seen.values() for w in x], pa.binary()).cast(pa.string())
            block, held = (np.repeat(np.asarray([k[i] for k in seen], t), size) for i, t in ((0, np.int32), (1, bool)))
            out = pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), words, pa.array(held, pa.bool_())], ["block", "word", "asked"])
            seen.clear()
            return out

        for b in batches:
            for k, held, text in zip(b.column("block").to_pylist(), b.column("held_out").to_pylist(), b.column("text"), strict=True):
                seen.setdefault((k, held), set()).update(tokens(text.as_py()))
            if sum(map(len, seen.values())) > FLUSH:
                yield flush()
        yield flush()

    # all columns, so that this and the cogroup below share one shuffle of the texts
    words = texts.mapInArrow(distinct, "block int, word string, asked boolean").join(vocab.select("word", "id", "c"), "word")
    # a word of a training document that is not among these was seen once
    words = words.filter("asked or c > 1").select("block", "word", "id", "c")

    def code(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        index = {w.encode(): i for i, w in enumerate(known["word"])}
        ids = np.append(known["id"].to_numpy(np.int32), np.array([-1, -2], np.int32))
        c = np.append(known["c"].to_numpy(np.int64), [1, 0])  # second last: seen once; last: unknown
        size, base = np.log10(np.maximum(c, 1)), np.log10((c + 0.1) / facts["all"])
        end = np.log10((facts["train_docs"] + 0.1) / facts["all"])
        rows = []
        for doc, held, text in zip(docs["doc_id"], docs["held_out"], docs["text"], strict=True):
            other = -1 if held else -2
            at = np.asarray([index.get(w, other) for w in tokens(text)], np.int64)
            rows.append((doc, held, len(at) + 1, int((c[at] > 0).sum()) + (facts["train_docs"] > 0), base[at].sum() + end, size[at].sum(), ids[at].tobytes()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CODED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(code, CODED)


def transitions(rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """Counts of class pairs over coded training documents, START before and END after each."""
    sent = rows.sparkSession.sparkContext.broadcast(table & (HEAD - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K * K, np.int64)
        for b in batches:
            for x in b.column(0):
                c = sent.value[np.frombuffer(x.as_py(), np.int32)].astype(np.int64)
                total += np.bincount(np.append(START, c) * K + np.append(c, END), minlength=K * K)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    out = np.zeros(K * K)
    for r in rows.select("ids").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(K, K)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class): Witten-Bell interpolation with the classes' own shares."""
    used = counts.sum(0) > 0
    used[[END, RARE]] = True
    own = np.where(used, counts.sum(0) + 0.5, 0)
    own /= own.sum()
    seen, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    p = np.where(seen > 0, (counts + kinds * own) / np.maximum(seen + kinds, 1), own)
    return np.log10(np.maximum(p, 1e-300))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents. Null and blank texts are their end token alone; without training documents every base
    probability is 1 and classes are unknown ones. Rows repeated or equal in id are scored each. Null ids count as the empty text
    for the split. Words of equal count are ordered by themselves. Texts of any length are scored whole. Other columns are not
    read. An empty table gives no rows."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_of_id() % 10 == 0).alias("held_out"))
    train = slim.filter("not held_out")
    counts = stored(word_counts(train))
    words, facts = numbered(counts, train, train.count())
    forget(counts)
    rows = stored(coded(slim, words, facts))
    learned = rows.filter("not held_out")
    table, facts = clustered(learned, words, facts)
    forget(words)
    steps, within, sent = smoothed(transitions(learned, table)), class_logs(facts), spark.sparkContext.broadcast(table)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for x, size in zip(b.column("ids"), b.column("counts").to_pylist(), strict=True):
                ids = np.frombuffer(x.as_py(), np.int32)
                c = sent.value[ids].astype(np.int64)
                emission = size + float(within[c[ids > -2]].sum()) + int((ids == -2).sum()) * float(np.log10(facts["unknown"]))
                scores.append(emission + float(steps[np.append(START, c), np.append(c, END)].sum()))
            out = {n: b.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")}
            out |= {"train_tokens": pa.array([facts["n"]] * len(b), pa.int64()), "base_score": b.column("base_score"), "score": pa.array(scores, pa.float64())}
            out["perplexity"] = pa.array([10 ** min(300.0, -s / n) for s, n in zip(scores, b.column("n_tokens").to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; odd rows as in score_documents()."""
    return score_documents(documents(spark, sf_dir))
