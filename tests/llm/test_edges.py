"""Edges of the operators, and their queries' columns against brute force and SQL."""

import hashlib
import os
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tripspark.llm import (
    common, op1_substring, op2_winnowing, op3_token_files, op4_simhash, op5_toxicity, op6_license, op7_decontaminate, op8_quality, op9_counts, op10_bpe, queries, stages)
from tripspark.llm.components import components
from tripspark.llm.prefix_bpe import ranks_of

DATA = "/root/testdata/sf0.001"


def test_links_at_every_radius(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "BUCKET", 10)
    rng = random.Random(16)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)}
    values = sorted(values)
    fps = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for radius in range(5):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in combinations(values, 2):
            if (a ^ b).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
        got = {r["a"] % 2**64: r["b"] % 2**64 for r in components(op4_simhash.links(fps, radius)).collect()}
        groups = lambda f: sorted(tuple(sorted(v for v in values if f(v) == k)) for k in {f(v) for v in values})
        assert groups(lambda v: got.get(v, v)) == groups(find), radius


def test_coordinates_discard_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 400, dtype=np.uint64)
    i, j = np.triu_indices(400, 1)
    assert op4_simhash.may_link(op4_simhash.pivot_table(fps), i, j, 4).mean() < 0.2  # of unrelated pairs
    near = fps ^ np.uint64(0b1111)
    both = np.concatenate((fps, near))
    assert op4_simhash.may_link(op4_simhash.pivot_table(both), np.arange(400), np.arange(400) + 400, 4).all()


def test_repeated_ids_in_a_labelled_sample(spark):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("words "), "id").alias("text")).union(spark.createDataFrame([(i, f"text {i}") for i in range(2, 40)], "doc_id int, text string"))
    labels = spark.createDataFrame([(i % 20 + 1, i % 2) for i in range(60)] + [(30, 0), (30, 1)], "doc_id int, quality int")
    got = common.labelled_sample(docs, labels, ["quality"], "doc_id", "text", 10, 1 << 20).collect()
    ids = [r["doc_id"] for r in got]
    assert len(got) == len(set(ids)) == 10 and 30 not in ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert sum(len(r["text"]) for r in common.labelled_sample(docs, labels, ["quality"], "doc_id", "text", 10, 30).collect()) <= 30
    op8_quality.train(docs, labels, rows=10)
    op5_toxicity.train(docs, labels.withColumnRenamed("quality", "toxic"), rows=10)


def test_edit_report_against_brute_force(spark):
    rng = random.Random(17)
    rows = [(i * 5, "".join(rng.choices("abcd efé", k=rng.randint(0, 300)))) for i in range(12)] + [(7, None), (8, "")]

    def plain(text, k=10, w=20):
        n = len(text)
        k = min(k, n)
        grams = [text[i : i + k] for i in range(n - k + 1)] if n else []
        value = {g: int(op2_winnowing.winnow(g, k)[0][0]) for g in grams}
        h = [value[g] for g in grams]
        w = min(w, len(h))
        return {h[max(range(i, i + w), key=lambda j: (-h[j], j))] for i in range(len(h) - w + 1)} if h else set()

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in op2_winnowing.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert set(op2_winnowing.parsed(got[i]["fingerprint"])[0].tolist()) == plain(t)
        assert got[i]["near_edited"] == pytest.approx(like(plain(t), plain(edited))) and got[i]["near_next"] == pytest.approx(like(plain(t), plain(u)))


def test_bpe_digests_against_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
    texts = [None, "", "a", "it's 12½ <|endoftext|>", "x" * 5000, "\U0001909c가 Ᲊ͸ 🙂🙂 \U00020000\U000104a0", "déjà vu " * 400]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in op10_bpe.digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_tokens_by_place(spark):
    out = common.new_path(spark, "tokens")
    docs = spark.createDataFrame([(i, "some words here " * (i % 5)) for i in range(30)], "doc_id long, text string")
    op3_token_files.write_tokens(docs, P.path("word_bpe_49k.json"), out)
    ids = [i for r in sorted(op3_token_files.read_documents(spark, out).collect(), key=lambda r: r["start"]) for i in np.frombuffer(r["ids"], "<u4").tolist()]
    places = [0, 1, 5, 5, 17, len(ids) - 1, len(ids), -1, None]
    got = op3_token_files.token_at(spark, out, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted((r["place"], r["token"]) for r in got) == sorted((p, ids[p]) for p in places if p is not None and 0 <= p < len(ids))


def test_chain_and_log_odds_against_plain_versions():
    rng = np.random.default_rng(5)
    links = [op5_toxicity.Link(rng.normal(size=20).astype(np.float32), rng.normal(size=k), 0.3) for k in range(3)]
    sets = [[0, 3, 4], [], [19]]
    doc, bucket = np.repeat(np.arange(3), [3, 0, 1]), np.array([0, 3, 4, 19])
    p = np.zeros((3, 0))
    for link in links:
        p = np.column_stack([p, link.predict(doc, bucket, p)])
    for row, own in zip(p, sets):
        before = []
        for link in links:
            z = sum(float(link.weight[b]) for b in own) + sum(x * y for x, y in zip(before, link.chain)) + link.bias
            before.append(1 / (1 + np.exp(-z)))
        assert row == pytest.approx(before)
    model = op8_quality.Model(rng.normal(size=op8_quality.BUCKETS).astype(np.float32), -0.2)
    texts = ["the cat the cat the cat", "", "Ünï code words", "a"]
    alone = [model.log_odds(pa.array([t]))[0] for t in texts]
    assert model.log_odds(pa.array(texts)) == pytest.approx(alone)  # neighbours in a slice don't leak into one another
    for t, odds in zip(texts, alone):
        want = model.bias
        for family in op8_quality.features(pa.array([t])):
            own = [float(model.value[b]) for bucket, _, used in family for b, u in zip(bucket, used) if u]
            want += sum(own) / len(own) if own else 0
        assert odds == pytest.approx(want, abs=1e-4)


def test_string_ids(spark):
    docs = spark.createDataFrame([("bench/1", "w1 w2 w3 " * 20), ("b", "w1 w2 w3 " * 20), (None, "x"), ("c", None)], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in op1_substring.substring_dedup(docs).collect()) == ["None", "b", "bench/1", "c"]
    assert {r["component_id"] for r in op4_simhash.near_duplicates(docs).filter("doc_id like 'b%'").collect()} == {"b"}
    bench = spark.createDataFrame([("q/1", "w2 w3 w1"), ("p/2", "none")], "item_id string, text string")
    got = {r["doc_id"]: r for r in op7_decontaminate.contamination(docs, bench)[0].collect()}
    assert got["bench/1"]["items"] == ["q/1"] and got["b"]["contaminated"] and got["c"]["n_words"] == 0 and got[None]["n_words"] == 1
    assert op6_license.scan(docs).count() == 4
    assert stages.decontaminate.__name__ == "decontaminate" and len(stages.near_duplicates(spark, docs, "").collect()) == 3


@pytest.mark.parametrize("rows", [[], [(1, "long word " * 100_000), (1, "long word " * 100_000), (2, None)]], ids=["empty", "a million characters"])
def test_empty_tables_and_long_texts(spark, rows):
    clash = "doc_id long, text string, p_toxic double, score double, changes string, ids string, decoded string, n_tokens string"
    docs = spark.createDataFrame([(*r, 0.5, 0.5, "c", "i", "d", "n") for r in rows], clash)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = len(rows)
    path, piece = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
    chain, model = op5_toxicity.train(docs, labels), op8_quality.train(docs, labels)
    got = {
        "op1": op1_substring.substring_dedup(docs), "op2": op2_winnowing.edit_report(docs), "op4": op4_simhash.near_duplicates(docs), "op5": op5_toxicity.predict(docs, chain), "op6": op6_license.scan(docs),
        "op8": op8_quality.score(docs, model), "op9": op9_counts.within_budget(op9_counts.prefix_counts(docs, piece), 9), "op10": op10_bpe.round_trip(docs, path)}
    for name, df in got.items():
        assert df.count() == n, name
    if n:
        assert got["op1"].agg(F.sum("n_removed")).first()[0] == 400_000 and got["op10"].filter("length(decoded) = 1000000").count() == 2
    out = common.new_path(spark, "tokens")
    op3_token_files.write_tokens(docs, P.path("word_bpe_49k.json"), out)
    assert op3_token_files.read_documents(spark, out).count() == n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    key = lambda t: sorted((tuple(r[c] for c in columns) for r in t.to_pylist()), key=str)
    assert key(got) == key(want)
