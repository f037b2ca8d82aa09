"""Operators for training text against brute force, libraries and edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripspark.llm import (
    op1_substring, op2_winnowing, op3_token_files, op4_simhash, op5_toxicity, op6_license, op7_decontaminate, op8_quality, op9_counts, op10_bpe, stages)
from tripspark.llm.components import components
from tripspark.llm.prefix_bpe import rank_file, splitter

WORDS = [f"w{i}" for i in range(60)]
ODD = [None, "", " \n\t ", "é", "İstanbul Σς x\x1c\x85y", "a" * 3000, "<|endoftext|> <s> </s>", "中文字 🙂 é", "'S don't 's 12 ½"]


def texts(seed=1, n=60):
    """Random texts of few words, with copies, shared passages and odd ones."""
    rng = random.Random(seed)
    passage = [" ".join(rng.choices(WORDS, k=40)) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 80)))]
        if i % 4 == 0:
            parts.append(rng.choice(passage))
        if i % 9 == 0:
            parts.append("ha " * rng.randint(30, 50))
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out + out[:3] + [out[0] + " extra", *ODD]


def table(spark, rows=None, more=True):
    """Documents with columns that clash with the operators' own; ids with gaps, one null, one row twice."""
    rows = texts() if rows is None else rows
    data = [(i * 3 + 1, t, "x", i, "y") for i, t in enumerate(rows)]
    if more:
        data += [(None, "null id text here", "x", 0, "y"), data[0]]
    return spark.createDataFrame(data, "doc_id long, text string, fp string, n_words int, k_id string")


def brute_kept(rows, window=35):
    words = [(t or "").encode().split() for t in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [b" ".join(x for i, x in enumerate(w) if i not in gone[d]).decode() for d, w in enumerate(words)], [len(g) for g in gone]


@pytest.mark.parametrize("window,base", [(35, 9), (8, 8), (20, 3)])
def test_substring_dedup(spark, window, base):
    docs = table(spark)
    rows = [r["text"] for r in docs.collect()]
    kept, gone = brute_kept(rows, window)
    got = op1_substring.substring_dedup(docs, window=window, base=base)
    assert got.columns == ["doc_id", "text", "fp", "k_id", "n_words", "n_removed", "kept"]
    want = sorted(zip([str(r) for r in rows], kept, gone))
    assert sorted((str(r["text"]), r["kept"], r["n_removed"]) for r in got.collect()) == want
    assert sum(gone) > 0


def test_substring_dedup_of_nothing(spark):
    assert op1_substring.substring_dedup(table(spark, [], False)).count() == 0
    clash = table(spark).withColumns({"spans_": F.lit(1), "runs_": F.lit(2), "piece": F.lit(3)})
    assert op1_substring.substring_dedup(clash).filter("spans_ = 1 and runs_ = 2 and piece = 3").count() == clash.count()


def test_winnowing_guarantee_and_ties(spark):
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choices("ab", k=rng.randint(0, 400)))
        h, at = op2_winnowing.winnow(text, 5, 8)
        n = len(text)
        if n:
            k = min(5, n)
            value = [op2_winnowing.winnow(text[i : i + k], 5, 8)[0][0] for i in range(n - k + 1)]
            w = min(8, len(value))
            want = {max(j for j in range(i, i + w) if value[j] == min(value[i : i + w])) for i in range(len(value) - w + 1)}
            assert set(at.tolist()) == want and [value[i] for i in at] == h.tolist()
        again = op2_winnowing.parsed(op2_winnowing.written(h, at))
        assert np.array_equal(again[0], h) and np.array_equal(again[1], at)
    shared = "".join(rng.choices("abcdefgh", k=119))
    a, b = (op2_winnowing.winnow("".join(rng.choices("xyz", k=300)) + shared + "".join(rng.choices("xyz", k=300)))[0] for _ in range(2))
    assert op2_winnowing.likeness(a, b) > 0


def test_edit_report(spark):
    rows = texts(5)
    for docs, ids in ((table(spark, rows, False), [i * 3 + 1 for i in range(len(rows))]), (table(spark, ["only one"], False), [1])):
        given = dict(zip(ids, rows if len(ids) > 1 else ["only one"]))
        got = {r["doc_id"]: r for r in op2_winnowing.edit_report(docs).collect()}
        assert len(got) == len(ids)
        for i, x in enumerate(ids):
            t, after = given[x] or "", given[ids[i - 1]] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert got[x]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[x]["n_chars"] == len(t)
            assert got[x]["edited_fingerprint"] == op2_winnowing.written(*op2_winnowing.winnow(edited)) and 0 <= got[x]["near_next"] <= 1
    usual = {r["doc_id"]: r for r in op2_winnowing.edit_report(table(spark, rows, False)).collect()}
    finer = {r["doc_id"]: r for r in op2_winnowing.edit_report(table(spark, rows, False), coarse=3, rows=4).collect()}
    assert usual == finer
    assert op2_winnowing.edit_report(table(spark)).count() == op2_winnowing.edit_report(table(spark), coarse=2, rows=5).count() == len(texts()) + 2
    assert op2_winnowing.edit_report(table(spark, [], False)).count() == 0


def test_token_files_round_trip(spark):
    path, docs = P.path("word_bpe_49k.json"), table(spark)
    library = Tokenizer.from_file(path)
    out = op3_token_files.new_path(spark, "tokens")
    op3_token_files.write_tokens(docs, path, out)
    got = op3_token_files.read_documents(spark, out).collect()
    rows = docs.collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_addressable_codes():
    rng = random.Random(4)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array(rng.choices([0, 1, 255, 256, 65535, 65536, 2**31], k=n), np.uint32)
        block = op3_token_files.Block(*op3_token_files.pack(ids))
        assert [block.token(i) for i in range(n)] == ids.tolist()
        a = rng.randint(0, n)
        assert block.tokens(a, n).tolist() == ids[a:].tolist()


def brute_fp(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(values, radius):
    root = {}
    for v in values:
        root[v] = v
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def test_simhash(spark):
    docs = table(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = {r["text"]: brute_fp(r["text"]) for r in rows}
    root = brute_components(sorted(set(fps.values())), 4)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            k = root[fps[r["text"]]]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    got = op4_simhash.near_duplicates(docs).collect()
    want = sorted((str(r["doc_id"]), fps[r["text"]], str(least.get(root[fps[r["text"]]]))) for r in rows)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want
    assert op4_simhash.near_duplicates(table(spark, [], False)).count() == 0


@pytest.mark.parametrize("bound", [None, 20])
def test_links_of_dense_and_scattered_fingerprints(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(op4_simhash, "BUCKET", bound)  # larger buckets are dealt out again
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    got = {r["a"] % 2**64: r["b"] % 2**64 for r in components(op4_simhash.links(fps, 4)).collect()}
    root = brute_components(values, 4)
    groups = lambda f: sorted(tuple(sorted(v for v in values if f(v) == k)) for k in {f(v) for v in values})
    assert groups(lambda v: got.get(v, v)) == groups(root.get)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["a"]: r["b"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def labelled(spark, column, good, bad):
    rng = random.Random(8)
    docs = [(i, (good if i % 2 else bad)(rng)) for i in range(200)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], f"doc_id long, {column} int")


def test_quality_classifier_on_held_out_rows(spark):
    plain = lambda rng: " ".join("".join(rng.choices("abcdeiost", k=rng.randint(2, 8))) for _ in range(60))
    junk = lambda rng: rng.choice([lambda: " ".join([rng.choice(WORDS)] * 50), lambda: "%%% ".join(plain(rng).split())])()
    docs, labels = labelled(spark, "quality", plain, junk)
    scored = op8_quality.score(docs, op8_quality.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.95
    empty = op8_quality.score(table(spark), op8_quality.train(docs, labels.limit(0)))
    assert {r["score"] for r in empty.collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    plain = lambda rng: " ".join("".join(rng.choices("abcdeiost", k=rng.randint(2, 4))) for _ in range(60))
    bad = lambda rng: " ".join([plain(rng), rng.choice(["idiot,", "scum", "Pathetic", "moron", "trash!"]), plain(rng)])
    docs, labels = labelled(spark, "toxic", bad, plain)
    chain = op5_toxicity.train(docs, labels)
    got = op5_toxicity.predict(docs, chain).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95
    kinds = [max(r[f"p_kind_{k}"] for k in (1, 2, 3)) for r in held if "idiot" in r["text"] or "moron" in r["text"]]
    assert np.mean(kinds) > 0.5
    named = op5_toxicity.predict(docs, op5_toxicity.train(docs, labels.withColumn("insult", F.col("toxic")), categories=["insult"]))
    assert named.columns == ["doc_id", "text", "p_insult", "p_toxic"]
    assert op5_toxicity.predict(table(spark), op5_toxicity.train(docs, labels.limit(0))).filter("p_toxic > 0.01").count() == 0


def test_license_scan(spark):
    mit = [t for n, t in op6_license.KNOWN if n == "MIT"][2]
    rows = ["Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper(), "text\nLicenced under the apache licence, version 2.0\nmore", mit + " and more", "Released under the MIT License.\nReleased under the MIT license", *ODD]
    got = {r["doc_id"]: r for r in op6_license.scan(table(spark, rows)).collect()}
    assert got[1]["license"] == "MIT" and got[4]["notices"] == ["Apache-2.0"] and got[4]["license"] is None and got[7]["license"] is None
    assert got[10]["notices"] == ["MIT"] and got[10]["n_notices"] == 2 and got[13]["digest"] is None
    assert op6_license.scan(table(spark, rows)).count() == len(rows) + 2 and op6_license.scan(table(spark, [], False)).count() == 0


def brute_hits(text, items, window=13):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(5, 30)))) for i in range(8)] + [(90, "É Ok"), (91, None), (92, ""), (3, "again w1 w2"), (93, "w1 " * 20)]
    rows = [" ".join([" ".join(rng.choices(WORDS, k=20)), rng.choice(items)[1] or "", " ".join((items[1][1]).split()[3:17]).upper(), "w1 " * rng.randint(0, 16)]) for _ in range(40)] + ["é ok", "É OK", *ODD]
    docs, bench = table(spark, rows), spark.createDataFrame(items + items[:1], "item_id long, text string")
    got, _ = op7_decontaminate.contamination(docs, bench)
    want = sorted((str(r["doc_id"]), *brute_hits(r["text"], items)) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got.collect()) == want
    assert op7_decontaminate.contamination(docs, bench.limit(0))[0].filter("n_hit > 0 or contaminated").count() == 0
    assert op7_decontaminate.contamination(table(spark, [], False), bench)[0].count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x x b"), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("a", 1), ("b", 2), ("", 0)], "term string, term_id long")
    index = op7_decontaminate.build_index(docs, terms).filter("term_id > 0")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair long, term_a long, term_b long")
    got = op7_decontaminate.proximity_hits(index, ["k_id", "k_text"], pairs, 3)
    assert sorted(r["k_id"] for r in got.collect()) == [1, 2]


def test_prefix_bpe_against_the_library():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe, split = rank_file(path), splitter(P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(2000):
        s = "".join(rng.choice("abcde 's'tÉñü中文字🙂́\x1c\x85\xa0 \n12９½ẞΣςreABC__-- ") for _ in range(rng.randint(0, 30)))
        assert [i for w in split(s) for i in bpe.encode(w.encode())] == library.encode_ordinary(s)
    for _ in range(100):
        seq = bytes(rng.choices(b"the and of ing", k=rng.randint(60, 200)))
        last, size = bpe.table(seq[:30])
        bpe.extend(seq, last, size)
        assert (last, size) == bpe.table(seq)
        at, cut, put = rng.randint(0, 20), rng.randint(0, 5), bytes(rng.choices(b"abc", k=rng.randint(0, 4)))
        fresh, new_last, new_size = bpe.edited(seq, last, size, at, cut, put)
        assert fresh == seq[:at] + put + seq[at + cut :] and (new_last, new_size) == bpe.table(fresh)


def test_bpe_round_trip(spark):
    path, docs = P.path("byte_bpe_multi_50k.tiktoken"), table(spark)
    got = op10_bpe.decode(op10_bpe.encode(docs, path), path)
    assert got.count() == docs.count() and got.filter(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert op10_bpe.encode(table(spark, [], False), path).count() == 0


def test_prefix_counts(spark):
    path, docs = P.path("piece_bpe_32k.model"), table(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in op9_counts.within_budget(op9_counts.prefix_counts(docs, path), 7).collect():
        t = r["text"] or ""
        assert r["n_tokens"] == len(sp.encode(t))
        counts = np.cumsum(np.frombuffer(r["changes"], np.int8), dtype=np.int64)
        if len(t) < 200:
            own = [len(sp.encode(t[:p])) for p in range(1, len(t) + 1)]
            assert counts[1:].tolist() == own and r["fits"] == max((p for p, n in enumerate(own, 1) if n <= 7), default=0)
    assert op9_counts.prefix_counts(table(spark, [], False), path).count() == 0


def test_stages_keep_columns(spark, tmp_path):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, texts()[1])], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    total = docs.count()
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        n = out.count()
        assert n == total if name in ("quality_classifier", "substring_dedup") else 0 < n < total, name
    left = [r["doc_id"] for r in stages.near_duplicates(spark, docs, str(tmp_path)).collect()]
    groups = op4_simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert len(left) == groups and len(set(left)) == len(left)
    last = stages.encode(spark, docs, str(tmp_path))
    assert last.count() == total and last.filter("not round_trip").count() == 0
