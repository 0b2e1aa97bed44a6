from collections import defaultdict

from tests.conftest import SF
from tests.llm.helpers import ROWS, SOURCES, plain, table, words
from tidemark.llm import mixing
from tidemark.llm.shared import documents


def test_targets_share_the_excess():
    t = mixing.targets({"a": 100, "b": 10, None: 90})
    assert abs(sum(t.values()) - 300) < 1e-9
    assert t["a"] <= 200 and t["b"] <= 20 and t[None] <= 180
    assert t["a"] == 200 and t["b"] == 20 and abs(t[None] - 80) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}


def check(rows, docs):
    size, took, aim = defaultdict(int), defaultdict(int), {}
    source = defaultdict(list)
    for r in docs.collect():
        source[r["doc_id"]].append(r["source"])
        size[r["source"]] += len(words(r["text"]))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]][0] if len(set(source[r["doc_id"]])) == 1 else None
        if len(set(source[r["doc_id"]])) == 1:
            took[s] += r["taken"]
            aim[s] = r["target"]
            assert r["source_size"] == size[s]
    return took, aim


def test_targets_are_met_to_the_word(spark):
    docs = documents(spark, SF)
    rows = plain(mixing.op9_mixing(spark, SF))
    took, aim = check(rows, docs)
    assert all(abs(took[s] - aim[s]) <= 1 for s in aim)
    again = {r["doc_id"]: r["taken"] for r in plain(mixing.mix_documents(docs.repartition(5)))}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_budgets_are_nested(spark):
    sized = mixing.measured(documents(spark, SF))
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mixed(sized, mixing.plan(sized, share=x)).collect()} for x in (0.3, 0.6))
    assert all(large[k] >= v for k, v in small.items())


def test_awkward_rows_and_empty_table(spark, tmp_path):
    docs = table(spark, path=str(tmp_path))
    rows = plain(mixing.op9_mixing(spark, str(tmp_path)))
    assert len(rows) == len(ROWS) and sorted(r["size"] for r in rows) == sorted(len(words(t)) for _, t in ROWS)
    check(rows, docs)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert {s for s in SOURCES} >= {r["source"] for r in out.collect()}
    table(spark, [], str(tmp_path))
    assert mixing.op9_mixing(spark, str(tmp_path)).count() == 0
