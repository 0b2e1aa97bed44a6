import hashlib

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import plain, table
from tidemark.llm import fingerprints as fp
from tidemark.llm.shared import documents


def ordered(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))


def edits(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return out


def key(x):
    return (x[0] is not None, x[0] or 0, *x[1:])


def test_edited_texts(spark, tmp_path):
    docs = table(spark, path=str(tmp_path))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in plain(fp.op3_fingerprints(spark, str(tmp_path)))]
    assert sorted(got, key=key) == sorted(edits(ordered(docs)), key=key)


def test_many_ranges(spark):
    docs = documents(spark, SF)
    near = {r["doc_id"]: r for r in fp.with_next(docs, 50).select("doc_id", "next_text").collect()}
    rows = ordered(docs)
    assert {i: r["next_text"] for i, r in near.items()} == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}


def test_estimates_near_truth(spark):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = ordered(documents(spark, SF))
    out = {r["doc_id"]: r for r in plain(fp.op3_fingerprints(spark, SF))}
    errors = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        a, b, c = shingles(t), shingles(t[: len(t) - m] + nxt[:m]), shingles(nxt)
        errors += [abs(len(a & b) / max(1, len(a | b)) - out[i]["near_edited"]), abs(len(a & c) / max(1, len(a | c)) - out[i]["near_next"])]
        assert abs(out[i]["distinct_shingles"] - len(a)) <= max(0.5, 0.5 * len(a))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25
    same = {}
    for i, t in rows:
        same.setdefault(t, set()).add(out[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_merging_parts(spark):
    docs = documents(spark, SF).select("source", fp.sketch(F.col("text")).alias("s"))
    got = {r["source"]: r["s"] for r in fp.merge_by(docs, ["source"], "s").collect()}
    want = {}
    for r in docs.collect():
        want.setdefault(r["source"], set()).update(r["s"])
    assert got == {k: sorted(v)[: fp.K] for k, v in want.items()}
    part = spark.sql("select array(1L,2L,3L) a, array(2L,3L,4L) b").select(fp.containment(F.col("a"), F.col("b")).alias("c"), fp.resemblance(F.col("a"), F.col("b")).alias("r")).first()
    assert abs(part["c"] - 2 / 3) < 1e-9 and part["r"] == 0.5


def test_empty_table_and_single_row(spark):
    assert fp.fingerprint_documents(table(spark, [])).count() == 0
    (row,) = plain(fp.fingerprint_documents(table(spark, [(5, "abcdefgh")])))
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0
