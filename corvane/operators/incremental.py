"""Processing only new or changed records.

Every distinct version of a record has a number in one of ``lanes`` independent sequences. Numbers are
given once: a version that comes later, however old its date, follows the last number of its lane. What
is done is a set of disjoint intervals of numbers; a run takes the available ranges minus those
intervals, so late records fall into gaps instead of behind a high-water mark, and a run that failed
leaves its numbers open. Versions that a newer one of their key replaces are closed as long as it does.

``Ledger`` keeps numbers and intervals between runs. ``pending`` has no store: it replays the order in
which runs took the versions, those that none has taken come last, so what is late moves no number of
a version that was taken.

Defined results
    rows without a key: not records, never pending. Null, blank or unreadable instants: the oldest.
    rows of one key and instant that differ: each must have been handled, else the key is pending.
    repeated rows: one version. Empty tables: nothing pending, or everything if nothing was handled.
    other columns: part of the record; a change in any column but the instant makes it pending.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import instant
from ..session import cut
from ..sources.manifests import Manifests
from . import intervals

#: Lanes of the sequence. Each is sorted by one task; more lanes than tasks cost nothing.
LANES = 4096


def _oldest() -> Column:
    """Stands for a missing instant, before all others."""
    return F.timestamp_micros(F.lit(-(1 << 62)))


def _packed(c: Column) -> Column:
    """A key as bytes without loss: hexadecimal keys at half their length, others as they are."""
    hexes = c.rlike("^([0-9a-f]{2})+$")
    return F.when(hexes, F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def _unpacked(c: Column) -> Column:
    body = F.substring(c, 2, 2**31 - 1)
    return F.when(F.hex(F.substring(c, 1, 1)) == "01", F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


def versions(records: DataFrame, key: str = "hash", at: str = "indexed_at") -> DataFrame:
    """(key, digest, at) of each row, repeats left out; keys are packed. The digest covers every column but the instant."""
    content = F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns if c != at]))))
    rows = records.where(F.col(key).isNotNull()).select(_packed(F.col(key)).alias("key"), content.alias("digest"), F.coalesce(instant(at), _oldest()).alias("at"))
    return rows.groupBy("key", "digest", "at").agg(F.lit(1).alias("one")).drop("one")


def _with_newest(items: DataFrame) -> DataFrame:
    last = items.groupBy("key").agg(F.max("at").alias("last"))
    return items.join(last, "key").withColumn("newest", F.col("at") == F.col("last")).drop("last")


def taken_versions(records: DataFrame, handled: DataFrame, key: str = "hash", at: str = "indexed_at", run: str | None = None, ok: str | None = None) -> DataFrame:
    """(key, digest, at, run, done, newest): one row per distinct content of a key, ``at`` its latest instant.

    ``handled``: (key, at) rows that runs have taken, in the order of ``run``; those of a run that did not
    succeed have a false ``ok``.
    """
    took = handled.where(F.col(key).isNotNull()).select(
        _packed(F.col(key)).alias("key"),
        F.coalesce(instant(at), _oldest()).alias("at"),
        (F.lit(0) if run is None else F.col(run)).cast("long").alias("run"),
        (F.lit(True) if ok is None else F.coalesce(F.col(ok), F.lit(False))).alias("done"),
    )
    took = took.groupBy("key", "at").agg(F.min("run").alias("run"), F.bool_or("done").alias("done"))
    rows = versions(records, key, at).join(took, ["key", "at"], "left")
    items = rows.groupBy("key", "digest").agg(F.max("at").alias("at"), F.min("run").alias("run"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))
    return _with_newest(items)


def lane(lanes: int) -> Column:
    """By hash of the version, so that a key with many versions spreads."""
    return F.pmod(F.xxhash64("key", "digest"), F.lit(lanes)).cast("int")


def numbered(items: DataFrame, order: list[Column], lanes: int = LANES, journal: DataFrame | None = None) -> DataFrame:
    """Adds (lane, seq). Versions of ``journal`` (key, digest, lane, seq) keep their numbers, others follow the last of their lane."""
    placed = items.withColumn("lane", lane(lanes))
    place = F.row_number().over(Window.partitionBy("lane").orderBy(*order)).cast("long")
    if journal is None:
        return placed.withColumn("seq", place)
    known = journal.select("key", "digest", "seq")
    last = journal.groupBy("lane").agg(F.max("seq").alias("last"))
    new = placed.join(known, ["key", "digest"], "left_anti").join(last, "lane", "left")
    new = new.withColumn("seq", place + F.coalesce("last", F.lit(0))).drop("last")
    return placed.join(known, ["key", "digest"]).unionByName(new)


def _gaps(items: DataFrame, closed: DataFrame) -> DataFrame:
    available = items.groupBy("lane").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return intervals.subtract(available, closed)


def _said(found: DataFrame) -> DataFrame:
    """Keys as they came, and null for a missing instant."""
    return found.withColumns({"key": _unpacked(F.col("key")), "at": F.when(F.col("at") != _oldest(), F.col("at"))})


def pending(
    records: DataFrame, handled: DataFrame, key: str = "hash", at: str = "indexed_at", lanes: int = LANES, run: str | None = None, ok: str | None = None
) -> DataFrame:
    """(key, digest, at) of the versions whose numbers the processed intervals leave open."""
    order = [F.col("run").asc_nulls_last(), F.col("at"), F.col("key"), F.col("digest")]
    items = cut(numbered(taken_versions(records, handled, key, at, run, ok), order, lanes))
    closed = intervals.from_points(items.where("done or not newest"))
    return _said(intervals.inside(items, _gaps(items, closed))).select("key", "digest", "at")


@dataclass(frozen=True)
class Taken:
    """What a run has to do: ``rows`` (key, digest, at, lane, seq) in the gaps, and the version of the ledger that left them open."""

    rows: DataFrame
    gaps: DataFrame
    version: int


class Ledger:
    """Numbers of versions and processed intervals, kept between runs and committed with the output.

    Every change writes new files and then publishes one small manifest under the next number, which only
    one writer can take. A run that dies before that leaves neither output nor progress; a run whose gaps
    come from an older version of the ledger is refused. ``folder`` must be on storage that all
    executors share.
    """

    def __init__(self, spark: SparkSession, folder: str, lanes: int = LANES):
        self.spark, self.folder, self.lanes = spark, folder, lanes
        self._manifests = Manifests(spark, folder)
        self._seen: int | None = None

    def state(self) -> dict | None:
        return self._manifests.last()

    def _now(self) -> dict:
        return self.state() or {"version": 0, "outputs": [], "intervals": None, "journal": [], "lanes": self.lanes}

    def _run(self) -> str:
        return os.path.join(self.folder, "runs", uuid.uuid4().hex)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _processed(self, state: dict) -> DataFrame:
        return self._read([state["intervals"]] if state["intervals"] else [], "lane int, lo long, hi long")

    def processed(self) -> DataFrame:
        return self._processed(self._now())

    def journal(self) -> DataFrame:
        """(key, digest, lane, seq) of all versions that have a number."""
        return self._read(self._now()["journal"], "key binary, digest binary, lane int, seq long")

    def output(self) -> DataFrame | None:
        state = self.state()
        return self.spark.read.parquet(*state["outputs"]) if state and state["outputs"] else None

    def gaps(self, available: DataFrame) -> DataFrame:
        """What is open of ``available``; a commit without a version of its own is bound to this moment."""
        state = self._now()
        self._seen = state["version"]
        return intervals.subtract(available, self._processed(state))

    def _publish(self, state: dict, changes: dict) -> bool:
        new = state | changes | {"version": state["version"] + 1}
        return self._manifests.publish(new["version"], new)

    def register(self, records: DataFrame, key: str = "hash", at: str = "indexed_at") -> int:
        """Give a number to each version that has none. Returns the ledger's version."""
        while True:
            state = self._now()
            items = versions(records, key, at).groupBy("key", "digest").agg(F.max("at").alias("at"))
            journal = self._read(state["journal"], "key binary, digest binary, lane int, seq long")
            new = items.join(journal.select("key", "digest"), ["key", "digest"], "left_anti")
            path = os.path.join(self._run(), "journal")
            numbered(new, [F.col("at"), F.col("key"), F.col("digest")], state["lanes"], journal).select("key", "digest", "lane", "seq").write.parquet(path)
            if self.spark.read.parquet(path).isEmpty():
                return state["version"]
            # Another writer may have numbered the same versions: then the numbers are given anew.
            if self._publish(state, {"journal": [*state["journal"], path]}):
                return state["version"] + 1

    def take(self, records: DataFrame, key: str = "hash", at: str = "indexed_at") -> Taken:
        """The versions that no committed run has processed and that no newer one of their key replaces."""
        self.register(records, key, at)
        state = self._now()
        journal = self._read(state["journal"], "key binary, digest binary, lane int, seq long")
        items = _with_newest(versions(records, key, at).groupBy("key", "digest").agg(F.max("at").alias("at")))
        items = cut(items.join(journal, ["key", "digest"]))
        # Replaced versions aren't stored as processed: a record may go back to one of them.
        replaced = intervals.from_points(items.where("not newest"))
        gaps = cut(_gaps(items, self._processed(state).unionByName(replaced)))
        self._seen = state["version"]
        return Taken(_said(intervals.inside(items.drop("newest"), gaps)), gaps, state["version"])

    def commit(self, output: DataFrame, taken: DataFrame | Taken, base_version: int | None = None) -> bool:
        """Publish ``output`` and mark the intervals ``taken`` as processed. False if the ledger has moved on since the gaps were taken."""
        base = taken.version if isinstance(taken, Taken) else self._seen if base_version is None else base_version
        if base is None:
            raise ValueError("take the gaps first, or name the version that they are of")
        state = self._now()
        if state["version"] != base:
            return False
        run = self._run()
        output.write.parquet(os.path.join(run, "output"))
        gaps = taken.gaps if isinstance(taken, Taken) else taken
        intervals.merge(self._processed(state).unionByName(gaps.select("lane", "lo", "hi"))).write.parquet(os.path.join(run, "intervals"))
        return self._publish(state, {"outputs": [*state["outputs"], os.path.join(run, "output")], "intervals": os.path.join(run, "intervals")})
