"""First conquests by the time of the trip, kept in state: rows may come late, change, or be withdrawn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstByTime(StatefulProcessor):
    """For each key its live trips with their times and its withdrawn ones (maps, an entry for each trip), the latest change
    seen, and the first conquest that was told last. A trip's later change counts, by (updated, deleted, time).

    A withdrawn trip is forgotten once the key has seen a change that is later by `remembered`: until then an older row of
    the trip that comes late stays out."""

    def __init__(self, keys: list[str], trip: str, at: str, updated: str, deleted: str, types: dict[str, str], remembered: object = None):
        self.keys, self.trip, self.at, self.updated, self.deleted, self.types, self.remembered = keys, trip, at, updated, deleted, types, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        t = self.types
        self.live = handle.getMapState("live", f"trip {t[self.trip]}", f"at {t[self.at]}, updated {t[self.updated]}")
        self.dead = handle.getMapState("dead", f"trip {t[self.trip]}", f"at {t[self.at]}, updated {t[self.updated]}")
        self.latest = handle.getValueState("latest", f"updated {t[self.updated]}")
        self.told = handle.getValueState("told", f"trip {t[self.trip]}, at {t[self.at]}")

    def take(self, trip, at, updated, deleted: bool) -> bool:
        """Take in one change; whether it counts."""
        for state, was_deleted in ((self.live, False), (self.dead, True)):
            if state.containsKey((trip,)):
                was_at, was_updated = state.getValue((trip,))
                if (updated, deleted, at) <= (was_updated, was_deleted, was_at):
                    return False
        (self.dead if deleted else self.live).updateValue((trip,), (at, updated))
        other = self.live if deleted else self.dead
        if other.containsKey((trip,)):
            other.removeKey((trip,))
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        told = self.told.get() if self.told.exists() else None
        first, again, latest = (told[1], told[0]) if told else None, False, None
        for frame in rows:
            for trip, at, updated, deleted in zip(*(frame[c].tolist() for c in (self.trip, self.at, self.updated, self.deleted))):
                latest = updated if latest is None else max(latest, updated)
                if not self.take(trip, at, updated, bool(deleted)):
                    continue
                if first is not None and first[1] == trip:
                    again = True  # the first itself has changed: its followers are looked through once, at the end
                elif not deleted and (first is None or (at, trip) < first):
                    first = (at, trip)
        self.forget(latest)
        if again:
            first = min(((value[0], k[0]) for k, value in self.live.iterator()), default=None)
        if first == ((told[1], told[0]) if told else None):
            return
        if first is None:
            self.told.clear()
        else:
            self.told.update((first[1], first[0]))
        out = {k: [v] for k, v in zip(self.keys, key)} | {self.trip: [first and first[1]], self.at: [first and first[0]]}
        yield pd.DataFrame(out, dtype=object)

    def forget(self, latest: object) -> None:
        if self.remembered is None:
            return
        if self.latest.exists():
            latest = max(latest, self.latest.get()[0])
        self.latest.update((latest,))
        for trip in [k[0] for k, value in self.dead.iterator() if value[1] < latest - self.remembered]:
            self.dead.removeKey((trip,))

    def close(self) -> None:
        pass


def first_conquests(changes: DataFrame, keys: list[str], trip: str = "trip_id", at: str = "trip_date", updated: str = "updated_at", deleted: str = "deleted", remembered: object = None) -> DataFrame:
    """A stream of keys, trip, at: the first conquest of each key by time (of equal times the least trip), each time that it
    changes; nulls where no trip is left. State has an entry for each trip of a key.

    changes: a stream of keys, trip, at, updated, deleted, in any order; null trips and times are left out. remembered: how much
    later (in what `updated` is subtracted by: a number, a timedelta) than a withdrawal a key's changes may be until it is forgotten; None: never. Needs the RocksDB
    state store, which is set unless the session names one of its own."""
    spark = changes.sparkSession
    if "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
    whole = changes.filter(F.col(trip).isNotNull() & F.col(at).isNotNull() & F.col(updated).isNotNull())
    whole = whole.select(*keys, trip, at, updated, F.coalesce(deleted, F.lit(False)).alias(deleted))
    types = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, trip, at))
    return whole.groupBy(*keys).transformWithStateInPandas(FirstByTime(keys, trip, at, updated, deleted, types, remembered), schema, "Update", "None")


def first_of_changes(changes: DataFrame, keys: list[str], trip: str = "trip_id", at: str = "trip_date", updated: str = "updated_at", deleted: str = "deleted") -> DataFrame:
    """What the stream leaves after all changes, as a batch: keys, trip, at."""
    whole = changes.filter(F.col(trip).isNotNull() & F.col(at).isNotNull() & F.col(updated).isNotNull())
    last = whole.groupBy(*keys, trip).agg(F.max(F.struct(F.col(updated).alias("u"), F.coalesce(deleted, F.lit(False)).alias("d"), F.col(at).alias("a"))).alias("x"))
    first = last.filter("not x.d").groupBy(*keys).agg(F.min(F.struct("x.a", F.col(trip).alias("t"))).alias("f"))
    return first.select(*keys, F.col("f.t").alias(trip), F.col("f.a").alias(at))
