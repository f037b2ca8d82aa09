"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tripspark.llm import op11_runs


def brute(words, times=4, least=6):
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def cases(seed):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 4 + ["a"], ["a"] * 100 + ["b"] + ["a"] * 7]
    for _ in range(60):
        text = []
        while len(text) < rng.randint(1, 400):
            unit = rng.choices("abc", k=rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))
            text += (unit * rng.randint(1, 9))[: rng.randint(1, 150)] if rng.random() < 0.7 else rng.choices("abcdef", k=rng.randint(1, 40))
        out.append(text)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    texts = cases(seed)
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    for times, least in ((4, 6), (3, 3), (5, 20)):
        got = op11_runs.find_runs([np.array([number[w] for w in t], int) for t in texts], times, least)
        for t, runs in zip(texts, got):
            assert [tuple(r) for r in runs.tolist()] == brute(t, times, least)


def test_blocks_of_the_grid(monkeypatch):
    texts = [np.array([ord(c) for c in t]) for t in cases(9)]
    want = op11_runs.find_runs(texts)
    monkeypatch.setattr(op11_runs, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(want, op11_runs.find_runs(texts)))


def test_extensions_against_brute_force():
    rng = np.random.default_rng(4)
    row = np.append(np.tile(rng.integers(0, 3, 50), 12)[: 50 * 11 + 17], 99)
    row[rng.integers(0, len(row) - 1, 6)] = 5
    i, j = rng.integers(0, len(row), (2, 4000))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i, j, op11_runs.Extensions(row).ask(i, j)):
        k = 0
        while max(a, b) + k < len(row) and row[a + k] == row[b + k]:
            k += 1
        assert got == k


def contract(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(t) if i % 5 else "  ".join(rng.choices(["é", "ünï", "x"], k=i))) for i, t in enumerate(cases(7) + cases(8) + cases(11))]
    rows += [(900, None), (901, ""), (902, " \n\t "), (3, "a a a a a a a"), (3, "a a a a a a a"), (903, "b\x0bc " * 3000), (904, "x\x1c y\x85 " * 9)]
    rows += [(i, f"w{i} " * 3 + " ".join(rng.choices("abcdefgh", k=rng.randint(1, 90)))) for i in range(1000, 1200)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_runs.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted([(i, *contract(i, t)) for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_edges(spark):
    schema = "doc_id string, text string, runs string, text_ int, strongest int"
    rows = [("a/1", "go " * 50_000, "r", 1, 2), (None, None, None, None, None), ("b", "one two", "r", 3, 4)]
    got = {r["doc_id"]: r for r in op11_runs.periodic_runs(spark.createDataFrame(rows, schema)).collect()}
    assert [tuple(r) for r in got["a/1"]["runs"]] == [(0, 50_000, 1)] and got["a/1"]["collapsed"] == "go" and got["a/1"]["text_"] == 1
    assert got[None]["runs"] == [] and got[None]["strongest"] is None and got[None]["collapsed"] == "" and got["b"]["collapsed"] == "one two"
    assert op11_runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    assert op11_runs.with_planted_runs(spark.createDataFrame([(None, "a b c", "")], "doc_id long, text string, words_ string")).first()["text"] == "a b c"
