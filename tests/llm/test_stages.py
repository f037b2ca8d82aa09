"""Stages of the pipeline against brute force."""

import random

import public_tokenizers as P
import tiktoken
from test_llm import brute_hits, brute_kept

from tripspark.llm import common, op8_quality, stages
from tripspark.llm.prefix_bpe import ranks_of


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"u{i}" for i in range(500)]
    shared, item = rng.choices(words, k=60), rng.choices(words, k=20)
    texts = [None, "", "one"]
    for i in range(30):
        own = rng.choices(words, k=rng.randint(20, 200))
        texts.append(" ".join(own + shared * (i % 3 == 0) + item * (i % 4 == 0)))
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept, gone = brute_kept(texts)
    got = {r["doc_id"]: r for r in stages.substrings(spark, docs, "").collect()}
    assert len(got) == len(texts) and sum(gone) > 0
    for i, t in enumerate(texts):
        assert got[i]["text"] == (kept[i] if gone[i] else t) and got[i]["n_chars"] == len(got[i]["text"] or "")

    hits = [brute_hits(t, [(1, " ".join(item))]) for t in texts]
    clean = [i for i, (n, hit, _) in enumerate(hits) if not (hit and 20 * hit >= n)]
    assert sorted(r["doc_id"] for r in stages.decontaminate(spark, docs, str(tmp_path)).collect()) == clean and len(clean) < len(texts)

    model = op8_quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = sorted(r["doc_id"] for r in op8_quality.score(docs, model).collect() if r["score"] >= 0.3)
    assert sorted(r["doc_id"] for r in stages.quality(spark, docs, str(tmp_path)).collect()) == good

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in stages.encode(spark, docs, "").collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_stages_leave_only_what_they_read(spark, tmp_path):
    import glob

    rows = [(i, f"w{i % 7} " + " ".join(f"x{j}" for j in range(40)), 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    spark.createDataFrame([(1, "x1 x2 x3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    folder = common.shared_dir(spark).removeprefix("file://") + f"/tripspark-{spark.sparkContext.applicationId}/*/*"
    for stage, stay in ((stages.near_duplicates, "first"), (stages.substrings, "spans"), (stages.decontaminate, "bad")):
        before = set(glob.glob(folder))
        out = stage(spark, docs, str(tmp_path))
        assert [p.rsplit("/", 1)[1] for p in set(glob.glob(folder)) - before] == [stay]
        out.collect()
