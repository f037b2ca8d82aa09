"""Exact dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripspark.llm import op12_exact


def rows(seed=2):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a", "A", "a ", "", None, "long " * 500, "é", "é", *[f"t{k}" for k in range(40)]])) for i in range(300)]
    return out + [(7, "hot")] * 3 + [(i, "hot") for i in range(400, 700)] + [(None, "hot"), (None, "alone"), (None, "alone")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts,ways", [(1, 16), (7, 2), (30, 3), (30, 100)])
def test_groups_against_brute_force(spark, keep, parts, ways):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
    got = op12_exact.exact_groups(docs, keep=keep, ways=ways).collect()
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(data)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r["text_sha256"] == sha]
        best = (max if keep == "largest" else min)([i for i in ids if i is not None], default=None)
        assert sorted(str(r["doc_id"]) for r in own) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(best, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [best]


def test_dedup_keeps_rows_whole(spark):
    schema = "doc_id string, text string, digest int, run string, place map<string,int>"
    data = [("b", "x", 1, "r", {"k": 1}), ("a/1", "x", 2, "r", None), ("a/1", "x", 3, "s", None), ("c", None, 4, "t", None), ("d", "", 5, None, None), (None, "y", 6, None, None)]
    docs = spark.createDataFrame(data, schema)
    got = op12_exact.exact_dedup(docs)
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["None", "a/1", "c"]
    assert op12_exact.exact_dedup(docs, keep="largest").filter("doc_id = 'd' or doc_id = 'b'").count() == 2
    assert op12_exact.exact_dedup(docs.limit(0)).count() == 0 and op12_exact.exact_groups(docs.limit(0)).count() == 0


def test_equal_digests_are_verified(spark, monkeypatch):
    monkeypatch.setattr(op12_exact.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    got = op12_exact.exact_groups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["keep_id"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_no_python_workers(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = op12_exact.op12_exact(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))
