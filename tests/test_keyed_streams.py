"""The keyed table under versions, and streams that keep one: batches in any order leave what one batch of everything leaves."""

import random

import pytest

from tripspark import streaming
from tripspark.streaming import table as kt
from tripspark.streaming.first import FirstByTime, first_of_changes

ROW = "id long, content string, updated_at long"


def batch(spark, rows):
    return spark.createDataFrame(rows, ROW)


def content(spark, path, version=None):
    return {r["id"]: (r["content"], r["updated_at"]) for r in kt.read_table(spark, path, version).collect()}


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = kt.merge_batch(batch(spark, [(i, "a", 5) for i in range(200)]), path, ["id"], buckets=16)
    assert len(first.folders) == 16 and content(spark, path) == {i: ("a", 5) for i in range(200)}
    second = kt.merge_batch(batch(spark, [(3, "b", 9), (3, "c", 8), (7, "old", 1)]), path, ["id"])
    moved = [b for b in second.folders if second.folders[b] != first.folders[b]]
    assert 1 <= len(moved) <= 2 and second.buckets == 16
    want = {i: ("a", 5) for i in range(200)} | {3: ("b", 9)}
    assert content(spark, path) == want and content(spark, path, 0)[3] == ("a", 5)
    got = kt.lookup(spark, path, spark.createDataFrame([(3,), (3,), (900,)], "id long"))
    assert [tuple(r) for r in got.collect()] == [(3, "b", 9)] and len(got.inputFiles()) <= 2
    kt.remove_old(spark, path, 1)
    assert content(spark, path) == want and kt.manifest(spark, path).version == 1 and len(list((tmp_path / "t" / "manifests").glob("[!.]*.json"))) == 1
    live = {f.split("/", 1)[1] for f in second.folders.values()}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t" / "data").glob("*/bucket_=*")} == live


def test_replay_failure_and_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    kt.merge_batch(batch(spark, [(1, "a", 1)]), path, ["id"], stream="s", batch=0)
    kt.merge_batch(batch(spark, [(1, "b", 2)]), path, ["id"], stream="s", batch=1)
    assert kt.merge_batch(batch(spark, [(1, "again", 9)]), path, ["id"], stream="s", batch=1).version == 1
    assert kt.merge_batch(batch(spark, [(2, "other", 1)]), path, ["id"], stream="s2", batch=0).version == 2
    batch(spark, [(1, "half", 99)]).withColumn("bucket_", kt.bucket_of(["id"], 64)).write.partitionBy("bucket_").parquet(f"{path}/data/{3:012d}")  # no manifest followed
    assert content(spark, path) == {1: ("b", 2), 2: ("other", 1)}
    kt.merge_batch(batch(spark, [(1, "c", 3)]), path, ["id"], stream="s", batch=2)
    assert content(spark, path) == {1: ("c", 3), 2: ("other", 1)}
    assert not kt.Files(spark, path).put_new(f"manifests/{3:012d}.json", "{}")
    with pytest.raises(ValueError):
        kt.merge_batch(batch(spark, [(1, "c", 3)]), path, ["content"])
    with pytest.raises(FileNotFoundError):
        kt.read_table(spark, str(tmp_path / "none"))


def test_empty_batches_and_rows_that_go(spark, tmp_path):
    path = str(tmp_path / "t")
    assert kt.merge_batch(batch(spark, []), path, ["id"], batch=0).folders == {} and content(spark, path) == {}
    kt.merge_batch(batch(spark, [(1, "x", 1), (None, "null key", 1)]), path, ["id"])
    from pyspark.sql import functions as F

    kt.merge_batch(batch(spark, [(1, "gone", 2)]), path, ["id"], gone=F.col("content") == "gone")
    assert content(spark, path) == {None: ("null key", 1)}


def files_of(spark, tmp_path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return streaming.read_changes(spark, str(tmp_path / "in"), schema, 1)


def test_upserts_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randrange(30), f"c{rng.random()}", rng.randrange(10**6)) for _ in range(25)] for _ in range(3)]
    path, cp = str(tmp_path / "t"), str(tmp_path / "cp")
    for k in range(3):
        stream = files_of(spark, tmp_path, ROW, batches[k : k + 1])
        streaming.stream_upserts(stream, path, cp, ["id"], buckets=8).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for i, c, at in sorted((r for b in batches for r in b), key=lambda r: r[2]):
        want[i] = (c, at)
    assert content(spark, path) == want and list(kt.manifest(spark, path).batches.values()) == [2]


CHANGE = "user_id long, item_key string, trip_id long, trip_date long, updated_at long, deleted boolean"


def changes(seed, n=160):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.choice("xyz"), rng.randrange(8), rng.randrange(6), k if rng.random() < 0.9 else max(0, k - 3), rng.random() < 0.3) for k in range(n)]


class Maps:
    """State in memory, with the calls that the processor makes."""

    def __init__(self):
        self.at = {}

    getMapState = getValueState = lambda self, name, *a, **k: self.at.setdefault(name, Maps())
    containsKey = lambda self, k: k in self.at
    getValue = lambda self, k: self.at[k]
    removeKey = lambda self, k: self.at.pop(k)
    iterator = lambda self: iter(self.at.items())
    exists = lambda self: "v" in self.at
    get = lambda self: self.at["v"]
    clear = lambda self: self.at.clear()

    def updateValue(self, k, v):
        self.at[k] = v

    def update(self, v):
        self.at["v"] = v


def plain_first(rows):
    last = {}
    for u, i, trip, at, updated, gone in rows:
        last[u, i, trip] = max(last.get((u, i, trip), (-1, False, -1)), (updated, gone, at))
    out = {}
    for (u, i, trip), (_, gone, at) in last.items():
        if not gone:
            out[u, i] = min(out.get((u, i), (99, 0)), (at, trip))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_state_holds_the_first_in_any_order(seed):
    import pandas as pd

    rng, names = random.Random(seed), [c.split()[0] for c in CHANGE.split(", ")]
    rows, told, state = changes(seed), {}, {}
    order, at = rng.sample(rows, len(rows)), 0
    while at < len(order):
        part = order[at : at + rng.randint(1, 30)]
        at += len(part)
        for key in sorted({r[:2] for r in part}):
            p = FirstByTime(["user_id", "item_key"], "trip_id", "trip_date", "updated_at", "deleted", dict.fromkeys(names, "long"))
            p.init(state.setdefault(key, Maps()))
            own = pd.DataFrame([r for r in part if r[:2] == key], columns=names)
            for out in p.handleInputRows(key, iter([own.iloc[:2], own.iloc[2:]]), None):
                told[key] = (out["trip_date"][0], out["trip_id"][0])
        assert {k: v for k, v in told.items() if v[1] is not None} == plain_first(order[:at])


def test_withdrawn_trips_are_forgotten():
    import pandas as pd

    names = [c.split()[0] for c in CHANGE.split(", ")]
    p, state = FirstByTime(["user_id", "item_key"], "trip_id", "trip_date", "updated_at", "deleted", dict.fromkeys(names, "long"), 10), Maps()
    p.init(state)

    def send(*rows):
        own = pd.DataFrame([(1, "x", *r) for r in rows], columns=names)
        return [(o["trip_id"][0], o["trip_date"][0]) for o in p.handleInputRows((1, "x"), iter([own]), None)]

    assert send((5, 3, 1, False)) == [(5, 3)] and send((5, 3, 2, True)) == [(None, None)]
    assert send((5, 3, 1, False)) == [] and send((6, 9, 12, False)) == [(6, 9)] and list(state.at["dead"].at) == [(5,)]
    assert send((7, 10, 13, False)) == [] and state.at["dead"].at == {} and send((5, 3, 1, False)) == [(5, 3)]


def test_stream_of_first_conquests(spark, tmp_path):
    rows = changes(3)
    rows += [(9, "only", 1, 5, 0, False), (9, "only", 1, 5, 1, True), (9, "late", 1, 5, 9, True), (9, "late", 1, 5, 3, False), (9, "null", None, 1, 1, False)]
    mixed = random.Random(1).sample(rows, len(rows))
    path, cp = str(tmp_path / "t"), str(tmp_path / "cp")
    for part in (mixed[:60], mixed[60:100], mixed[100:]):
        stream = files_of(spark, tmp_path, CHANGE, [part])
        streaming.stream_first_conquests(stream, path, cp, ["user_id", "item_key"], buckets=4).trigger(availableNow=True).start().awaitTermination()
    got = {(r["user_id"], r["item_key"]): (r["trip_date"], r["trip_id"]) for r in kt.read_table(spark, path).collect()}
    mart = {(r["user_id"], r["item_key"]): (r["trip_date"], r["trip_id"]) for r in first_of_changes(spark.createDataFrame(rows, CHANGE), ["user_id", "item_key"]).collect()}
    assert got == mart == plain_first([r for r in rows if r[2] is not None]) and len(got) == 9


def test_a_buckets_rows_are_several_tasks_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kt, "PART_ROWS", 50)
    path = str(tmp_path / "t")
    for k in range(2):
        now = kt.merge_batch(batch(spark, [(i, f"v{k}", k) for i in range(400)]), path, ["id"], buckets=2)
    files = [len(list((tmp_path / "t" / f).glob("*.parquet"))) for f in now.folders.values()]
    assert len(files) == 2 and min(files) > 1 and content(spark, path) == {i: ("v1", 1) for i in range(400)}


def test_first_conquests_call_no_python_for_each_key_and_forget(spark, tmp_path):
    path, cp = str(tmp_path / "t"), str(tmp_path / "cp")
    parts = [[(1, "x", 5, 3, 1, False), (None, "x", 5, 3, 1, False)], [(1, "x", 5, 3, 2, True), (1, "x", 6, 9, 30, False)], [(1, "x", 5, 3, 1, False)], [(1, "x", 6, 9, 31, True)]]
    want = [{1: 5, None: 5}, {1: 6, None: 5}, {1: 5, None: 5}, {1: 5, None: 5}]
    for part, firsts in zip(parts, want):
        stream = streaming.stream_first_conquests(files_of(spark, tmp_path, CHANGE, [part]), path, cp, ["user_id", "item_key"], buckets=2, remembered=10).trigger(availableNow=True).start()
        stream.awaitTermination()
        assert stream.lastProgress is None or not stream.lastProgress["stateOperators"]
        assert {r["user_id"]: r["trip_id"] for r in kt.read_table(spark, path).collect()} == firsts
