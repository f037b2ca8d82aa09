"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tripspark.llm import op13_collocations


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    held = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i : i + k]] = max(held[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * held[lang, w] >= inside * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def table(seed=1, n=120):
    rng = random.Random(seed)
    words = [*"abcdefghij", "É", "zé", "New", "york", "the", "x\x1cy", "\x85", "中文", "a-b"]
    fixed = ["new york city", "the end", "a b c d e f"]
    out = []
    for _ in range(n):
        parts = [rng.choice([*rng.choices(words, k=rng.randint(1, 6)), *fixed]) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for p in parts)))
    return out + [(None, None), ("en", ""), ("fr", " . "), out[0], out[0], ("en", "solo words here " * 2000)]


@pytest.mark.parametrize("longest,least,inside,top", [(3, 10, 50, 2000), (2, 3, 50, 7), (5, 4, 80, 2000)])
@pytest.mark.parametrize("head,fill", [(1 << 16, 16), (1 << 16, 1 << 20), (6, 16)])
def test_against_brute_force(spark, monkeypatch, longest, least, inside, top, head, fill):
    if head < 100 and longest != 3:
        pytest.skip("one length is enough")
    rows = table()
    docs = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, rank int").repartition(3)
    known = op13_collocations.frequent

    def smaller(units):  # a head of few units sends most pairs to the sparse way
        whole = known(units)
        return op13_collocations.Frequent(whole.head[:head], whole.bits)

    monkeypatch.setattr(op13_collocations, "frequent", smaller)
    monkeypatch.setattr(op13_collocations, "FILL", fill)
    got = op13_collocations.collocations(docs, longest=longest, least=least, inside=inside, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, longest, least, inside, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_tiles_count_as_coordinates_do(monkeypatch):
    rng = np.random.default_rng(6)
    head = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    known = op13_collocations.Frequent(head, np.zeros(1 << 18, np.uint64))
    units = np.concatenate((head, rng.integers(0, 2**63, 50, dtype=np.uint64)))
    a, b = units[np.minimum(rng.geometric(0.004, (2, 60_000)), len(units) - 1)]
    for fill in (0, 16, 1 << 30):
        monkeypatch.setattr(op13_collocations, "FILL", fill)
        x, y, n = op13_collocations.count_pairs(a, b, known, known)
        got = dict(zip(zip(x.tolist(), y.tolist()), n.tolist()))
        assert len(got) == len(x) and got == Counter(zip(a.tolist(), b.tolist()))


def test_scores_are_exact(spark):
    cases = [(10**12 - 1, 10**12, 10**12 + 7), (3_000_000_019, 3_000_000_019, 2**40), (1, 1, 1), (10, 2**62, 2**62)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r["s"] for r in df.select(op13_collocations.cut_score(df.a, df.l, df.r).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "lang string, text string, unit int")
    assert op13_collocations.collocations(none).count() == 0
    one = spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")
    assert op13_collocations.collocations(one).count() == 0
