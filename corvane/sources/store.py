"""A graph store of versioned parquet folders.

Tables are cut into buckets by hash of their key. A writer makes new files of the buckets it touches beside
the old ones and then publishes a small manifest under the next number, which only one writer can take;
readers follow the last manifest, so several tables change together or not at all. Old versions stay until
``vacuum``. Upserts are the merge rules of ``graph_build``; each applied batch is remembered by its id in
the same manifest, so a repeated batch changes nothing. A batch reads and writes its buckets only.

Columns in ``OPTIONAL`` belong to a table from the first batch on that brings them; older rows hold null.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph_build as G
from .manifests import Manifests

SCHEMA_VERSION = 6
#: Buckets of a new store; a large one wants enough that a bucket is a few hundred megabytes.
BUCKETS = 32
_FILES = "array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint,diff:string>>"
TABLES = {
    "entities": "id string, type string, name string, aliases array<string>, description string, first_seen string, last_seen string, frequency bigint",
    "relations": "id string, type string, source_id string, target_id string, weight double, description string, evidence array<string>, first_seen string, last_seen string",
    "text_units": "id string, content string, commit_hashes array<string>, date_start string, date_end string, entity_ids array<string>, relation_ids array<string>",
    "communities": "id string, level int, title string, summary string, entity_ids array<string>, parent_id string, child_ids array<string>",
    "commits": "hash string, author_name string, author_email string, date string, message string, parent_hashes array<string>",
    "embeddings": "id string, text_hash string, embedding array<float>",
    "text_unit_entities": "text_unit_id string, entity_id string",
    "community_entities": "community_id string, entity_id string",
}
OPTIONAL = {
    "entities": "metadata map<string,string>, embedding array<float>",
    "communities": "embedding array<float>",
    "commits": f"text_unit_id string, indexed_at string, files_changed {_FILES}",
}


def key_of(name: str) -> str:
    return TABLES[name].split()[0]


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self._manifests = Manifests(spark, folder)

    # ---- versions ----

    def manifest(self) -> dict:
        found = self._manifests.last()
        if found is None:
            return {"version": 0, "schema": SCHEMA_VERSION, "buckets": self.buckets, "tables": {}, "columns": {}, "meta": {}, "batches": {}}
        if found["schema"] > SCHEMA_VERSION:
            raise ValueError(f"the store has schema {found['schema']}, newer than {SCHEMA_VERSION}")
        return {"buckets": self.buckets, "columns": {}} | found

    def _columns(self, m: dict, name: str) -> StructType:
        """The table's schema: its fixed columns and the optional ones that some batch has brought."""
        more = [c for c in StructType.fromDDL(OPTIONAL[name]) if c.name in m["columns"].get(name, [])] if name in OPTIONAL else []
        return StructType([*StructType.fromDDL(TABLES[name]).fields, *more])

    def _read(self, m: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        stored, schema = m["tables"].get(name, {}), self._columns(m, name)
        paths = [stored] if isinstance(stored, str) else [p for b, p in stored.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self._read(self.manifest(), name)

    def _bucket(self, m: dict, name: str) -> F.Column:
        return F.pmod(F.xxhash64(key_of(name)), F.lit(m["buckets"])).cast("int")

    def _touched(self, m: dict, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(m, name).alias("b")).distinct().collect()]

    def publish(
        self, tables: dict[str, DataFrame | tuple[DataFrame, list[int]]], meta: dict[str, str] | None = None, batch: tuple[str, int] | None = None, base: dict | None = None, **fields
    ) -> int:
        """Write new versions of the tables, or of their given buckets, and make them visible together. Returns the version.

        ``base``: the manifest that the rows were made from; if it isn't the last one any more, nothing changes.
        """
        old = base or self.manifest()
        run = os.path.join(self.folder, "data", uuid.uuid4().hex)
        new = {k: dict(v) if isinstance(v, dict) else v for k, v in old.items()} | {"version": old["version"] + 1, "schema": SCHEMA_VERSION} | fields
        for name, given in tables.items():
            df, buckets = given if isinstance(given, tuple) else (given, None)
            path = os.path.join(run, name)
            df.withColumn("_b", self._bucket(new, name)).repartition("_b").write.partitionBy("_b").parquet(path)
            fs, p = self._manifests.fs(path), self._manifests.path(path)
            written = {n.split("=")[1]: os.path.join(path, n) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("_b=")}
            kept = {} if buckets is None else {b: q for b, q in old["tables"].get(name, {}).items() if int(b) not in buckets}
            new["tables"][name] = kept | written
        new["meta"] |= meta or {}
        if batch:
            new["batches"][batch[0]] = batch[1]
        if not self._manifests.publish(new["version"], new):
            raise RuntimeError("another writer published first; nothing was changed")
        return new["version"]

    def vacuum(self) -> None:
        """Delete the data and manifests that the last manifest doesn't need."""
        keep = set()
        for stored in self.manifest()["tables"].values():
            for p in [stored] if isinstance(stored, str) else stored.values():
                keep.add(os.path.relpath(p, os.path.join(self.folder, "data")).split(os.sep)[0])
        folder = os.path.join(self.folder, "data")
        fs, data = self._manifests.fs(folder), self._manifests.path(folder)
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)
        for n in self._manifests.names()[:-1]:
            fs.delete(self._manifests.path(os.path.join(self._manifests.folder, n)), False)

    def migrate(self) -> int:
        """Bring an older store to the present schema, one published step at a time. Returns the schema it had."""
        had = self.manifest()["schema"]
        while (m := self.manifest())["schema"] < SCHEMA_VERSION:
            step = m["schema"] + 1
            out: dict[str, DataFrame] = {}
            if step == 2:  # junction tables from the id lists; ids that no entity has are left out
                known = self._read(m, "entities")
                out["text_unit_entities"] = G.junction(self._read(m, "text_units"), "entity_ids", known, "text_unit_id")
                out["community_entities"] = G.junction(self._read(m, "communities"), "entity_ids", known, "community_id")
            columns = m["columns"]
            if step == 4:  # embeddings of entities and communities
                columns = columns | {n: sorted({*columns.get(n, []), "embedding"}) for n in ("entities", "communities")}
            if step == 6:  # tables in buckets
                out = {n: self._read(m, n) for n, stored in m["tables"].items() if isinstance(stored, str)}
            # Steps 3 and 5 were indexes of a row store; buckets and column statistics stand for them.
            self.publish(out, base=m, schema=step, columns=columns)
        return had

    # ---- merges ----

    def apply(
        self, entities: DataFrame | None = None, relations: DataFrame | None = None, text_units: DataFrame | None = None, commits: DataFrame | None = None,
        communities: DataFrame | None = None, embeddings: DataFrame | None = None, meta: dict[str, str] | None = None, batch: tuple[str, int] | None = None,
    ) -> bool:
        """Merge a batch. False, without any change, if (stream, number) ``batch`` was applied before."""
        m = self.manifest()
        if m["schema"] < SCHEMA_VERSION:
            self.migrate()
            m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return False
        given = {"entities": entities, "relations": relations, "text_units": text_units, "commits": commits, "communities": communities, "embeddings": embeddings}
        given = {n: df for n, df in given.items() if df is not None}
        brought = {n: [c.name for c in StructType.fromDDL(OPTIONAL[n]) if c.name in df.columns] for n, df in given.items() if n in OPTIONAL}
        m = m | {"columns": m["columns"] | {n: sorted({*m["columns"].get(n, []), *cols}) for n, cols in brought.items()}}
        out: dict[str, tuple[DataFrame, list[int]]] = {}
        for name, df in given.items():
            schema = self._columns(m, name)
            rows = df.select(*[F.col(c.name).cast(c.dataType) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in schema]).where(F.col(key_of(name)).isNotNull())
            buckets = self._touched(m, name, rows)
            old = self._read(m, name, buckets)
            both = old.withColumn("loaded_at", F.lit(0)).unionByName(rows.withColumn("loaded_at", F.lit(1)))
            if name == "entities":
                merged = G.upsert_entities(both)
            elif name == "relations":
                merged = G.upsert_relations(both)
            elif name in ("communities", "embeddings"):
                merged = old.join(rows.select("id"), "id", "left_anti").unionByName(rows.dropDuplicates(["id"]))
            else:
                merged = G.insert_or_ignore(old, rows, key_of(name))
            out[name] = (merged.select(*schema.names), buckets)
        known = self._read(m, "entities").select("id")
        if "entities" in given:
            known = known.unionByName(given["entities"].select("id"))
        for name, owner, junction in (("text_units", "text_unit_id", "text_unit_entities"), ("communities", "community_id", "community_entities")):
            if name in out:
                out[junction] = (G.junction(out[name][0], "entity_ids", known, owner), out[name][1])
        self.publish(out, meta, batch, base=m)
        return True

    def put_embeddings(self, rows: DataFrame, model: str | None = None) -> None:
        """Store (id, text_hash, embedding). Vectors of another model make all that is stored void."""
        if model is not None and self.manifest()["meta"].get("embedding_model", model) != model:
            self.publish({"embeddings": self.spark.createDataFrame([], TABLES["embeddings"])})
        self.apply(embeddings=rows, meta={"embedding_model": model} if model is not None else None)

    def clear(self, only_communities: bool = False) -> None:
        """Empty the graph; commits' checkpoint and text hashes go with it, other metadata stays."""
        names = ["communities", "community_entities"] if only_communities else list(TABLES)
        meta = {} if only_communities else {"last_indexed_commit": ""}
        self.publish({n: self.spark.createDataFrame([], TABLES[n]) for n in names}, meta)

    def stats(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("entities", "relations", "text_units", "communities", "commits")}
