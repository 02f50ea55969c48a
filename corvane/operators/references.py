"""References to records that do not exist.

Method: the distinct non-null foreign keys, pre-aggregated per key, are left-anti-joined
against the parent keys that were there in time; the few keys that remain are joined back to
the references. A hot key is one row on the anti-join, whatever share of the rows points at it, and is
split by a salt where it is joined back.

Defined results
    null or blank reference: no reference. Null arrays: no reference.
    null record id: such rows keep a null ``record_id``; each counts from its own load time.
    null load time of a parent or of a record: the parent isn't late (it can still be missing).
    tombstone without ``deleted_at``: the key stays deleted. Blank tombstone keys name nothing.
    repeated rows and repeated references: one row each; ``loaded_at`` is the record's first.
    empty tables: no parents means every reference is missing; no records means no rows.
    other columns are ignored, whatever their names; texts of any length are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key


#: Parts of the references to one key.
SALTS = 16


def _tagged(keys: Column, name: str, target: str) -> Column:
    keys = F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias("field_name"), F.lit(target).alias("target"), norm_key(k).alias("ref_key")))


@dataclass(frozen=True)
class Referrer:
    """A table whose rows refer to others. ``fields``: field name -> parent table; arrays hold many keys."""

    name: str
    rows: DataFrame
    fields: dict[str, str]
    id_col: str = "id"
    time_col: str = "loaded_at"


@dataclass(frozen=True)
class Parent:
    name: str
    rows: DataFrame
    id_col: str = "id"
    time_col: str = "loaded_at"


@dataclass(frozen=True)
class ReferenceCheck:
    referrers: list[Referrer]
    parents: list[Parent]
    tombstones: DataFrame | None = None
    grace: str = "1 day"

    def _late(self, parent_first: Column, record_first: Column) -> Column:
        return F.coalesce(parent_first > record_first + F.expr(f"interval {self.grace}"), F.lit(False))

    def references(self) -> DataFrame:
        """(table_name, field_name, record_id, target, ref_key, loaded_at), with repeats."""
        parts = []
        for r in self.referrers:
            kinds = dict(r.rows.dtypes)
            rows = r.rows.select(
                norm_key(r.id_col).alias("record_id"),
                F.col(r.time_col).cast("timestamp").alias("own"),
                *[F.col(f).alias(f"f{i}") for i, f in enumerate(r.fields)],
            )
            # Only records with several rows need the other rows' load times.
            several = (
                rows.where("record_id is not null")
                .groupBy("record_id")
                .agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1")
                .select("record_id", "first")
            )
            rows = rows.join(several, "record_id", "left")
            arrays = []
            for i, (name, target) in enumerate(r.fields.items()):
                keys = F.col(f"f{i}") if kinds[name].startswith("array") else F.array(f"f{i}")
                arrays.append(_tagged(keys, name, target))
            parts.append(
                rows.select(
                    F.lit(r.name).alias("table_name"),
                    "record_id",
                    F.coalesce("first", "own").alias("loaded_at"),
                    F.explode(F.concat(*arrays)).alias("ref"),
                )
                .select("table_name", "ref.field_name", "record_id", "ref.target", "ref.ref_key", "loaded_at")
                .where("ref_key is not null")
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def live_keys(self) -> DataFrame:
        """(target, ref_key, first_loaded) of each key that is live."""
        parts = []
        for p in self.parents:
            parts.append(
                p.rows.select(F.lit(p.name).alias("target"), norm_key(p.id_col).alias("ref_key"), F.col(p.time_col).cast("timestamp").alias("at"))
            )
        keys = parts[0]
        for p in parts[1:]:
            keys = keys.unionByName(p)
        keys = (
            keys.where("ref_key is not null")
            .groupBy("target", "ref_key")
            .agg(F.min("at").alias("first_loaded"), F.max("at").alias("last_loaded"))
        )
        if self.tombstones is None:
            return keys.drop("last_loaded")
        deleted = (
            self.tombstones.select(norm_key("table_name").alias("target"), norm_key("record_key").alias("ref_key"), F.col("deleted_at").cast("timestamp").alias("deleted_at"))
            .where("ref_key is not null")
            .groupBy("target", "ref_key")
            .agg(F.max("deleted_at").alias("deleted_at"))
            .withColumn("named", F.lit(True))
        )
        return (
            keys.join(deleted, ["target", "ref_key"], "left")
            .where("named is null or last_loaded > deleted_at")
            .select("target", "ref_key", "first_loaded")
        )

    def orphans(self) -> DataFrame:
        """(table_name, field_name, record_id, ref_key, reason, loaded_at), one row per distinct reference without a live key in time."""
        refs, live = self.references(), self.live_keys()
        keys = refs.groupBy("target", "ref_key").agg(F.min("loaded_at").alias("earliest"))
        a, b = keys.alias("a"), live.alias("b")
        same = (F.col("a.target") == F.col("b.target")) & (F.col("a.ref_key") == F.col("b.ref_key"))
        open_keys = a.join(b, same & ~self._late(F.col("b.first_loaded"), F.col("a.earliest")), "left_anti")
        open_keys = open_keys.join(live.withColumn("live", F.lit(True)), ["target", "ref_key"], "left").select(
            "target", "ref_key", "live", "first_loaded"
        )
        # A key may hold a third of all references: they meet its copies under a salt.
        salted = open_keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        refs = refs.withColumn("salt", F.pmod(F.xxhash64("record_id", "field_name"), F.lit(SALTS)).cast("int"))
        return (
            refs.join(salted, ["target", "ref_key", "salt"])
            .where(F.col("live").isNull() | self._late(F.col("first_loaded"), F.col("loaded_at")))
            .groupBy("table_name", "field_name", "record_id", "ref_key")
            .agg(
                F.max(F.when(F.col("live").isNull(), "missing").otherwise("late")).alias("reason"),
                F.min("loaded_at").alias("loaded_at"),
            )
        )

    def report(self) -> DataFrame:
        """Counts per table, field and month of the record's first load."""
        return (
            self.orphans()
            .groupBy("table_name", "field_name", F.date_format("loaded_at", "yyyy-MM").alias("period"))
            .agg(
                F.count(F.lit(1)).alias("n_references"),
                F.count_if(F.col("reason") == "missing").alias("n_missing"),
                F.count_if(F.col("reason") == "late").alias("n_late"),
            )
        )
