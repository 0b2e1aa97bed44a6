import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm.helpers import ROWS, plain, table
from tidemark.llm import packing, tokens
from tidemark.llm.shared import Encoder, documents, scratch


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def pack_ids(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t\x1c\x85　é́'<|endoftext|>"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_cache_equals_whole_encoding(text):
    enc = test_word_cache_equals_whole_encoding.__dict__.setdefault("enc", Encoder(tokens.default_tokenizer(), 50))
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == want


def test_files_round_trip(spark, tok, tmp_path):
    for path, docs in ((SF, documents(spark, SF)), (str(tmp_path), table(spark, path=str(tmp_path)))):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want, start = Counter(), 0
        for i, t in rows:
            x = [*ids(tok, t), 2]
            want[(i, start, len(x), pack_ids(x))] += 1
            start += len(x)
        got = Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in plain(tokens.op7_token_files(spark, path)))
        assert got == want
    assert tokens.file_digest(table(spark, []), tokens.default_tokenizer(), 2).count() == 0


def test_unknown_keys_are_not_found(spark):
    docs = documents(spark, SF).select("doc_id", "text")
    folder = scratch(spark)
    tokens.write_shards(docs, folder, tokens.default_tokenizer(), 2, rows_per_shard=300).collect()
    keys = spark.createDataFrame([(0, 3), (0, 10**9), (1, -5)], "shard long, key long")
    assert [r["key"] for r in tokens.read_keys(keys, folder).collect()] == [3]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    mph = tokens.PerfectHash.build(keys)
    assert sorted(mph.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_histogram(spark, tok, tmp_path):
    for path, docs in ((SF, documents(spark, SF)), (str(tmp_path), table(spark, path=str(tmp_path)))):
        n = [len(ids(tok, r["text"])) + 1 for r in docs.collect()]
        rows = plain(tokens.op2_token_counts(spark, path))
        assert {r["length"]: r["documents"] for r in rows} == Counter(n)
        for r in rows:
            assert r["documents_from"] == sum(x >= r["length"] for x in n)
            assert r["tokens_upto"] == sum(x for x in n if x <= r["length"])
            assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in n)
            assert abs(r["quantile"] - sum(x <= r["length"] for x in n) / len(n)) < 1e-12
    hist = tokens.histogram(tokens.lengths(documents(spark, SF), tokens.default_tokenizer(), 1))
    n = [len(ids(tok, r["text"])) + 1 for r in documents(spark, SF).collect()]
    limits = [0, 1, 100, 777, 10**6]
    assert {r["context_limit"]: r["tokens"] for r in tokens.truncated_total(hist, limits).collect()} == {x: sum(min(x, y) for y in n) for x in limits}
    assert tokens.histogram(tokens.lengths(table(spark, []), tokens.default_tokenizer())).count() == 0


def naive_fit(sizes, room):
    free, out = [], []
    for s in sizes:
        for b, r in enumerate(free):
            if r >= s:
                out.append((b, room - r))
                free[b] -= s
                break
        else:
            out.append((len(free), 0))
            free.append(room - s)
    return out


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_tree_finds_the_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert list(zip(*packing.first_fit(sizes, 50), strict=True)) == naive_fit(sizes, 50)


def test_packing(spark, tok, tmp_path):
    for path, docs in ((SF, documents(spark, SF)), (str(tmp_path), table(spark, path=str(tmp_path)))):
        rows = plain(packing.op4_packing(spark, path))
        want = Counter()
        for r in docs.collect():
            x = [*ids(tok, r["text"]), 1]
            for at in range(0, len(x), 2048):
                want[(r["doc_id"], at, len(x[at : at + 2048]), pack_ids(x[at : at + 2048]), len(x))] += 1
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
        seq = {}
        for r in rows:
            seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        if path == SF:
            assert sum(r["length"] for r in rows) / (2048 * len(seq)) > 0.99
    assert packing.pack_documents(table(spark, []), tokens.default_tokenizer()).count() == 0
    with_ids = packing.pieces(documents(spark, SF), tokens.default_tokenizer(), with_ids=True).limit(5).collect()
    assert all(pack_ids(r["ids"]) == r["ids_crc32"] for r in with_ids)


def test_rows_are_all_here(spark, tmp_path):
    table(spark, path=str(tmp_path))
    assert sum(r["documents"] for r in plain(tokens.op2_token_counts(spark, str(tmp_path)))) == len(ROWS)


def test_encoder_gives_the_ids_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.shared import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), Encoder(path, most_bytes=80_000)
    letters = [f"{chr(i)}b, B{chr(i)}!! {chr(i)}" for i in range(0x21, 0x260) if i not in (0x85, 0xA0)]
    odd = ["It's o'clock' 's x'S ,,a a,, a_b _ <|endoftext|> a<|endoftext|>b <|startoftext|>", "é ́e 中文 ١٢ 🙂| A|", "a" * 3000 + ",,", "", " \t\n"]
    for text in [*letters, *odd, " ".join(letters)]:
        assert list(memoryview(enc.ids(text)).cast("I")) == plain.encode(text, add_special_tokens=False).ids
