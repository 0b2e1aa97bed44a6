"""Collocations against plain counting, and the parse against plain words."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import collocations as C
from tests.llm.helpers import LONG, ROWS

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, times long, core long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for w in (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))) if w]


def plain(rows, least, first):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            s, _, left, right = min(cuts)
            inside = any(100 * b >= C.SHARE * a for (m, v), b in f.items() if m == lang and len(v) > len(w) and b >= least and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)))
            if not inside:
                out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:first], 1))


def check(spark, rows, least, first=2000):
    frame = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in C.collocations(frame, least, first).collect())
    assert got == plain(rows, least, first)
    return got


def made(n, seed, vocabulary=12, langs=("en", "de", None)):
    r = random.Random(seed)
    words = ["The", "é", "a\x1cb", "naïve"] + [f"w{i}" for i in range(vocabulary)]
    gap = [" ", " ", " ", "\t", "  ", ", ", ".\n", " ; ", "\x0b"]
    return [(i, "".join(r.choice(words) + r.choice(gap) for _ in range(r.randint(0, 60))), r.choice(langs)) for i in range(n)]


def test_odd_rows(spark):
    odd = [(i, t, "en") for i, t in ROWS if t != LONG] + [(None, "of the of the. of, the", None), (1, "of THE of the", None), (2, "...", "x"), (3, " \t ", "x"), (4, "of the", "und")]
    check(spark, odd, 2)
    check(spark, odd, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, monkeypatch, seed):
    """Short cores, so that most phrases reach over the end of one; few words counted at a time."""
    monkeypatch.setattr(C, "TRIGGER", 3)
    monkeypatch.setattr(C, "MOST_CORE", 4)
    monkeypatch.setattr(C, "WORDS_AT_ONCE", 200)
    check(spark, made(80, seed), 5)
    check(spark, made(80, seed), 3, first=7)


def test_copies_and_long_texts(spark):
    """A third of all rows is one text, one text is very long, one word is half of all words."""
    check(spark, [(i, "same passage again and again, in every copy. same passage", "en") for i in range(60)] + [(99, "the x " * 3000, "en")] + made(60, 3), 30)


def test_no_rows(spark):
    assert check(spark, [], 1) == []
    assert check(spark, [(1, None, None), (2, "one", "en")], 1) == []


def test_parse_covers_each_word_once():
    r = random.Random(5)
    texts = ["".join(r.choice("ab  .\tXé\n") for _ in range(r.randint(0, 300))) for _ in range(50)]
    chunks, core, text = C.parse(pa.array(["skipped", *texts]).slice(1))
    for i, t in enumerate(texts):
        got = [w for c, n, k in zip(chunks.to_pylist(), core, text, strict=True) if k == i for w in c.split(" ")[:n]]
        assert [w.lstrip("\n") for w in got] == [w for p in pieces(t) for w in p]
        assert sum(w[0] == "\n" for w in got) == len(pieces(t))


def test_long_texts_are_cut_behind_stops():
    text = "one two. " * 100 + "three four five" * 50
    parts = C._short(text, 64)
    assert "".join(parts) == text and all(p[-1] == "." for p in parts[:-1]) and len(parts) > 5


def test_exact_beyond_64_bits(spark):
    rows = [("en", "a", 9 * 10**12), ("en", "b", 7 * 10**12), ("en", "a b", 5 * 10**12)]
    got = C.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).first()
    assert got["score"] == 2_000_000 * 5 * 10**12 // (16 * 10**12)


def test_copies_are_not_broadcast(spark, tmp_path):
    """Spark sizes the copies of words as the packed table they come from: no join may broadcast them for that."""
    spark.range(200).selectExpr("'en' as lang", "if(id % 2 = 0, concat('w', id), concat('w', id - 1, ' w', id - 1)) as phrase", "id + 30 as f").write.parquet(f"{tmp_path}/counted")
    plan = C.without_parts(C.scored(spark.read.parquet(f"{tmp_path}/counted")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan
