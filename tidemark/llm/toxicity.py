"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A document is read as overlapping windows of 32 words, 16 apart; its score comes from its most toxic window. A word of
more than 64 characters, as in scripts without white space, is read as pieces, each of them a step like a word. Each word
enters the network twice: as an embedding of the word, and as the pooled embeddings of its character five-grams, so
unseen forms of known stems count. The network is trained in numpy on a bounded sample of labelled documents: windows
of toxic documents are chosen anew in each round as those the network finds most toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_of_id, documents, give_back, lean, segments, small_batches

WINDOW, STRIDE, HIDDEN, WORD, CHAR, CELLS, GRAM = 32, 16, 8, 6, 6, 2**15, 5
#: Labelled documents per class that training may collect.
SAMPLE = 2000
ROUNDS, LEAST_STEPS, BATCH, RATE, THRESHOLD, CACHE = 6, 150, 64, 0.01, 0.3, 100_000
#: One in so many documents of each class is kept from training and only sets the calibration.
CALIBRATE = 5
SIZE = WORD + CHAR
#: Characters of a text that are read at a time.
PART = 1 << 18
#: Characters up to which a word is one step; characters of the pieces of longer words, and what neighbours share.
LONGEST, PIECE, OVERLAP = 64, 32, 4


def steps(text: str) -> list[str]:
    """Words in lower case, long ones cut into consecutive pieces."""
    words = text.lower().split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        out += [w] if len(w) <= LONGEST else [w[i : i + PIECE] for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return out


def cells(word: str) -> tuple[int, list[int]]:
    """Table cells of a word and of its five-grams of UTF-8 bytes, ends marked."""
    raw = f"^{word}$".encode()
    return crc32(raw) % CELLS, [crc32(raw[i : i + GRAM], 1) % CELLS for i in range(max(1, len(raw) - GRAM + 1))]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.empty(0, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """p: parameters by name; slope, shift: from a window's logit to a document's calibrated logit."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.0
    trained: bool = True
    cache: dict = field(default_factory=dict, repr=False)
    gates: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        n = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": 0.1 * g.standard_normal((CELLS, WORD)).astype(np.float32), "char": 0.1 * g.standard_normal((CELLS, CHAR)).astype(np.float32)}
        for d in "fb":
            p |= {f"wx{d}": n(SIZE, 3 * HIDDEN), f"wh{d}": n(HIDDEN, 3 * HIDDEN), f"bx{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"wa": n(2 * HIDDEN, HIDDEN), "va": n(HIDDEN, 1), "wo": n(2 * HIDDEN, 1), "bo": np.zeros(1, np.float32)}
        return cls(p)

    # ------------------------------------------------------------ inputs

    def inputs(self, words: list[str], most: int = 20_000) -> np.ndarray:
        if len(words) > most:
            return np.concatenate([self.inputs(words[i : i + most]) for i in range(0, len(words), most)])
        got = [cells(w) for w in words]
        flat = np.asarray([c for _, cs in got for c in cs], np.int64)
        n = np.asarray([len(cs) for _, cs in got])
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(n) - n, 0) / np.sqrt(n)[:, None]
        return np.concatenate([self.p["word"][[w for w, _ in got]], chars], 1).astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of `gates` for words: what a word adds to both directions' gates, computed once while it is cached."""
        cache = self.cache
        try:
            return np.asarray([cache[w] for w in words], np.int64)
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in cache]
            if len(cache) + len(new) > CACHE or self.gates is None:
                cache.clear()
                self.gates = np.zeros((1, 6 * HIDDEN), np.float32)  # row 0 pads
                new = list(dict.fromkeys(words))
            x = self.inputs(new)
            at = len(cache) + 1
            both = np.concatenate([x @ self.p["wxf"] + self.p["bxf"], x @ self.p["wxb"] + self.p["bxb"]], 1)
            if at + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(len(new), len(self.gates)), 6 * HIDDEN), np.float32)])
            self.gates[at : at + len(new)] = both
            cache.update(zip(new, range(at, at + len(new)), strict=True))
            return np.asarray([cache[w] for w in words], np.int64)

    # ------------------------------------------------------------ forward

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window. gates: (steps, windows, 6 x hidden), mask: (steps, windows). keep: gets what the
        backward pass needs."""
        steps, n, _ = gates.shape
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        for d, (name, order) in enumerate((("f", range(steps)), ("b", range(steps - 1, -1, -1)))):
            wh, h, side = self.p[f"wh{name}"], np.zeros((n, HIDDEN), np.float32), []
            for t in order:
                x, u = gates[t, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], h @ wh
                zr = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                new = h + m * (1 - z) * (c - h)
                if keep is not None:
                    side.append((t, h, z, r, c, u[:, 2 * HIDDEN :], m))
                h = new
                states[d, t] = h
            if keep is not None:
                keep.append(side)
        both = np.concatenate([states[0], states[1]], 2)
        a = np.tanh(both @ self.p["wa"])
        e = np.where(mask > 0, (a @ self.p["va"])[..., 0], -1e9)
        w = np.exp(e - e.max(0)) * (mask > 0)
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * both).sum(0)
        if keep is not None:
            keep += [both, a, w, pooled]
        return (pooled @ self.p["wo"])[:, 0] + self.p["bo"][0]

    # ------------------------------------------------------------ backward

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss, for all but the tables, and for the inputs x (steps, windows, size)."""
        p, keep = self.p, []
        gates = np.concatenate([x @ p["wxf"] + p["bxf"], x @ p["wxb"] + p["bxb"]], 2)
        out = self.run(gates, mask, keep)
        sides, (both, a, w, pooled) = keep[:2], keep[2:]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        do = ((_sigmoid(out) - label) / len(label)).astype(np.float32)[:, None]
        g["wo"], g["bo"] = pooled.T @ do, do.sum(0)
        dpool = do @ p["wo"].T
        dw = (both * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[..., None] * p["va"][:, 0] * (1 - a * a)
        g["va"] = np.einsum("tnk,tn->k", a, de)[:, None]
        g["wa"] = np.einsum("tni,tnk->ik", both, da)
        dboth = w[..., None] * dpool + da @ p["wa"].T
        dx = np.zeros_like(x)
        for d, name in enumerate("fb"):
            wh, dh = p[f"wh{name}"], np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, uc, m in reversed(sides[d]):
                dh = dh + dboth[t, :, HIDDEN * d : HIDDEN * (d + 1)]
                dz = m * dh * (h - c) * z * (1 - z)
                dc = m * dh * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                g[f"wx{name}"] += x[t].T @ dg
                g[f"bx{name}"] += dg.sum(0)
                g[f"wh{name}"] += h.T @ du
                dx[t] += dg @ p[f"wx{name}"].T
                dh = dh * (1 - m * (1 - z)) + du @ wh.T
        return g, dx

    # ------------------------------------------------------------ documents

    def logits(self, words: list[str], most: int = 4096) -> np.ndarray:
        """Logit of every window of one document's words."""
        return self.many([words], most)[0]

    def tops(self, texts: list[list[str]], place: bool = False, most_words: int = 60_000) -> list[float]:
        """The largest window logit of each document, or the window that has it. Documents run in groups of about
        most_words words, so that memory does not follow their number."""
        out, group, held = [], [], 0
        for i, ws in enumerate(texts):
            group.append(ws)
            held += len(ws)
            if held > most_words or i == len(texts) - 1:
                out += [int(x.argmax()) if place else float(x.max()) for x in self.many(group)]
                group, held = [], 0
        return out

    def many(self, texts: list[list[str]], most: int = 2048) -> list[np.ndarray]:
        """Window logits of several documents, run together in blocks of `most` windows."""
        if not texts:
            return []
        flat = self.rows([w for ws in texts for w in ws])
        at, rows, count = 0, [], []
        for ws in texts:
            s = window_starts(len(ws))
            rows.append(np.stack([at + s, at + np.minimum(s + WINDOW, len(ws))], 1))
            count.append(len(s))
            at += len(ws)
        span, out = np.concatenate(rows), []
        flat = np.append(flat, np.zeros(WINDOW, np.int64))
        for i in range(0, len(span), most):
            lo, hi = span[i : i + most, 0], span[i : i + most, 1]
            place = lo + np.arange(WINDOW)[:, None]
            mask = (place < hi).astype(np.float32)
            gates = self.gates[np.where(mask > 0, flat[place], 0)] if self.gates is not None else np.zeros((*mask.shape, 6 * HIDDEN), np.float32)
            out.append(self.run(gates, mask))
        logit = np.concatenate(out) if out else np.empty(0, np.float32)
        return np.split(logit, np.cumsum(count)[:-1]) if count else []

    def score(self, top: float) -> float:
        """Probability of a document from its largest window logit."""
        return float(_sigmoid(np.float64(self.slope * top + self.shift))) if self.trained else self.share

    def __getstate__(self) -> dict:
        return {"p": self.p, "slope": self.slope, "shift": self.shift, "share": self.share, "trained": self.trained, "cache": {}, "gates": None}


def _adam(p: dict, g: dict, state: dict, step: int, rate: float) -> None:
    for k, v in g.items():
        m, s = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
        m += 0.1 * (v - m)
        s += 0.001 * (v * v - s)
        p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def _prior(net: Network, texts: list[list[str]], label: np.ndarray) -> None:
    """Start each table cell's first number at how much oftener toxic documents hold it."""
    seen = np.zeros((2, 2, CELLS))
    for ws, y in zip(texts, label, strict=True):
        got = [cells(w) for w in set(ws)]
        seen[0, y, list({w for w, _ in got})] += 1
        seen[1, y, list({c for _, cs in got for c in cs})] += 1
    share = label.mean()
    for k, name in enumerate(("word", "char")):
        both = seen[k].sum(0)
        toxic, clean = (seen[k, 1] + 4 * share) / ((both + 4) * share), (seen[k, 0] + 4 * (1 - share)) / ((both + 4) * (1 - share))
        net.p[name][:, 0] = np.clip(np.log(toxic / clean), -3, 3)


def train(texts: list[str], label: np.ndarray, toxic_share: float, seed: int = 7) -> Network:
    """Train on whole documents. toxic_share: of all labelled documents; it sets the calibration, since the sample is balanced."""
    net, g = Network.new(seed), np.random.default_rng(seed)
    docs, label = [steps(t) for t in texts], np.asarray(label, np.int64)
    keep = [i for i, ws in enumerate(docs) if ws]
    docs, label = [docs[i] for i in keep], label[keep]
    net.share = toxic_share
    if not len(label) or label.min() == label.max():
        net.trained = False
        return net
    kind = np.zeros(len(label), np.int64)
    for y in (0, 1):
        kind[label == y] = np.arange((label == y).sum())
    spare = (kind % CALIBRATE == CALIBRATE - 1) if min(np.bincount(label)) >= 2 * CALIBRATE else np.zeros(len(label), bool)
    every, every_label = docs, label  # those to spare only calibrate
    docs, label = [d for d, out in zip(docs, spare, strict=True) if not out], label[~spare]
    _prior(net, docs, label)
    state, step = {}, 0
    for turn in range(max(ROUNDS, -(-LEAST_STEPS * BATCH // (2 * len(docs))))):
        net.cache, net.gates = {}, None
        if turn:
            chosen = net.tops(docs, place=True)
        else:
            chosen = []
            for ws in docs:
                x = net.inputs(ws)
                odds = x[:, 0] + x[:, WORD]
                chosen.append(int(np.argmax([np.sort(odds[s : s + WINDOW])[-2:].sum() for s in window_starts(len(ws))])))
        examples = [(i, w, y) for i, (w, y) in enumerate(zip(chosen, label, strict=True))]
        examples += [(i, int(g.integers(len(window_starts(len(docs[i]))))), 0) for i in np.flatnonzero(label == 0)]
        order = g.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            part = [examples[j] for j in order[at : at + BATCH]]
            windows = [docs[i][w * STRIDE : w * STRIDE + WINDOW] for i, w, _ in part]
            names = list(dict.fromkeys(w for ws in windows for w in ws))
            index, x = {w: j for j, w in enumerate(names)}, net.inputs(names)
            rows = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part)), np.float32)
            for j, ws in enumerate(windows):
                rows[: len(ws), j] = [index[w] for w in ws]
                mask[: len(ws), j] = 1
            grads, dx = net.gradients(x[rows] * mask[..., None], mask, np.asarray([y for *_, y in part], np.float32))
            dx = dx * mask[..., None]
            each = np.stack([np.bincount(rows.ravel(), dx[..., k].ravel(), len(names)) for k in range(SIZE)], 1)
            got = [cells(w) for w in names]
            step += 1
            dword, dchar = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(dword, [w for w, _ in got], each[:, :WORD].astype(np.float32))
            n = np.asarray([len(cs) for _, cs in got])
            np.add.at(dchar, [c for _, cs in got for c in cs], np.repeat(each[:, WORD:] / np.sqrt(n)[:, None], n, 0).astype(np.float32))
            grads |= {"word": dword, "char": dchar}
            _adam(net.p, grads, state, step, RATE)
    net.cache, net.gates = {}, None
    if spare.any():
        docs, label = [d for d, out in zip(every, spare, strict=True) if out], every_label[spare]
    top = np.asarray(net.tops(docs), np.float64)
    net.cache, net.gates = {}, None
    _calibrate(net, top, label, toxic_share)
    return net


def _calibrate(net: Network, top: np.ndarray, label: np.ndarray, share: float) -> None:
    """Logistic fit from a document's largest logit to its label, classes weighted to their shares; a small penalty keeps
    separable samples finite."""
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum())) * len(label)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * top + b)
        r, v = weight * (p - label), weight * p * (1 - p)
        grad = np.array([(r * top).sum() + 0.1 * (a - 1), r.sum()])
        hess = np.array([[(v * top * top).sum() + 0.1, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - da, 0.05, 20)), float(np.clip(b - db, -50, 50))
    net.slope, net.shift = a, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most `sample` documents per class, those of smallest id hash, among labelled rows whose
    crc32(doc_id) mod 4 is not 2. Rows with a null id or label teach nothing."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(crc_of_id() % 4 != 2).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = {}
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).groupBy("doc_id").agg(F.first("toxic").alias("toxic"))
        ids |= {r["doc_id"]: y for r in part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not ids:
        return train([], np.empty(0, np.int64), 0.0)
    chosen = docs.sparkSession.createDataFrame([(i, y) for i, y in ids.items()], "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").toArrow().to_pylist()  # at most 2 x sample ids
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    net = train([r["text"] for r in rows], np.asarray([r["toxic"] for r in rows]), share.get(1, 0) / sum(share.values()))
    del rows
    give_back()
    return net


def document_scores(net: Network, texts: list[str | None]) -> list[float]:
    """Score of each whole text, over all its windows; a very long text is read in parts, with the same windows as if it
    were read at once. Texts without words score as if their only window were empty: the same for all of them."""
    group: list[list[str]] = []
    owner: list[int] = []
    best, held = np.full(len(texts), -np.inf), 0

    def flush() -> None:
        for i, x in zip(owner, net.many(group), strict=True):
            if len(x):
                best[i] = max(best[i], float(x.max()))
        group.clear()
        owner.clear()

    for i, t in enumerate(texts):
        words: list[str] = []
        parts = segments(t or "", PART)
        part = next(parts, "")
        while part is not None:
            words, part = words + steps(part), next(parts, None)
            whole = max(0, (len(words) - WINDOW) // STRIDE + 1)  # windows that further words do not change
            use = words if part is None else words[: (whole - 1) * STRIDE + WINDOW] if whole else []
            words = words[whole * STRIDE :]
            if use:
                group.append(use)
                owner.append(i)
                held += len(use)
            if held > 60_000:
                flush()
                held = 0
    flush()
    return [net.score(x if np.isfinite(x) else float(net.p["bo"][0])) for x in best]


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = document_scores(net, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array([int(x >= THRESHOLD) for x in got], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """docs, all columns, without the rows predicted toxic. Null and empty texts are judged by the score of no words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x < THRESHOLD for x in document_scores(net, b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, one row each, by a network that learns from the labelled rows not held out.

    Null and empty texts score like texts without words; rows that repeat an id or a text are scored each; a null id counts
    as the empty text for held_out and is never learned from. Without labels all score 0. An empty table gives no rows;
    columns but doc_id and text are not read.
    """
    docs = documents(spark, sf_dir)
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net).select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")
