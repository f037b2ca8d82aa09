"""Groups of similar texts against all pairs."""

import random

import numpy as np

from tripspark.llm import op4_simhash, similar, stages


def brute_set(text, k=5):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_left(rows, fingerprints=False):
    """Smallest ids of the groups that pairs of likeness 0.8 or more link, or also fingerprints of 4 differing bits or fewer."""
    own = [op4_simhash.fingerprint((t or "").encode()) if fingerprints else 0 for _, t in rows]
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near = fingerprints and (int(own[i]) ^ int(own[j])).bit_count() <= 4
            if near or (len(a & b) / len(a | b) if a | b else 1) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))})


def test_near_duplicates_at_the_limit(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    texts = [None, "", "\t ", "one two", "ONE two", "one two three"]
    for _ in range(8):
        base = rng.choices(words, k=rng.randint(30, 200))
        line = rng.choices(words, k=8)
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own + line * rng.randint(0, 1)))
    texts += texts[-3:]
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in stages.near_duplicates(spark, docs, "").collect())
    assert got == brute_left(rows) and 10 < len(got) < len(rows)


def test_exactly_four_fifths(spark):
    whole = [f"a{i}" for i in range(14)]  # 10 shingles
    rows = [(1, " ".join(whole)), (2, " ".join(whole[:12])), (3, " ".join(whole[:11]))]  # 8 of 10, 7 of 8, 7 of 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in stages.near_duplicates(spark, docs, "").collect()] == [1]
    apart = docs.filter("doc_id <> 2")
    assert sorted(r["doc_id"] for r in stages.near_duplicates(spark, apart, "").collect()) == [1, 3]
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_rarest_shingles_keep_alike_pairs():
    rng = np.random.default_rng(5)
    level = rng.integers(0, 4, similar.COUNTERS).astype(np.uint8)
    alike = 0
    for _ in range(600):
        every = np.unique(rng.integers(0, 2**63, rng.integers(2, 60), dtype=np.uint64))
        a, b = (np.sort(rng.choice(every, rng.integers(-(-len(every) * 4 // 5), len(every) + 1), replace=False)) for _ in "ab")
        if similar.alike(a, b):
            alike += 1
            assert len(np.intersect1d(similar.rarest(a, level), similar.rarest(b, level)))
    assert alike > 100


def test_crowded_places(spark):
    """Many texts around one passage, a few of them alike: groups are those of all pairs, wherever a place counts as crowded."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(80):
        own = [f"o{i}_{j}" for j in range(rng.choice([4, 12, 30]))]
        rows.append((10 * i, " ".join(own + passage)))
        if i % 5 == 0:
            rows.append((10 * i + 1, " ".join([*own[:-1], "other", *passage])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_left(rows, fingerprints=True)
    assert 10 < len(want) < len(rows)
    for crowd in (0, 10**9):
        groups = similar.similar_groups(docs, crowd=crowd).groupBy("group").agg({"k_id": "min"}).collect()
        assert sorted(r[1] for r in groups) == want, crowd
