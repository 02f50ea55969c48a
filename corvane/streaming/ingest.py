"""Incremental ingestion of commits by Structured Streaming.

The stream's checkpoint is the position in the log; each micro-batch is merged into the store under its
number, so a batch that is repeated after a failure isn't applied twice. With ``availableNow`` a run
takes what is new and ends; a run without new files starts no batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import entity_id
from ..operators import graph_build as G
from ..sources.store import GraphStore


def graph_of(commits: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a batch of commits: people, modules, ownership and co-change."""
    clean = G.clean_commits(commits)
    changes = G.file_changes(clean, depth)
    none = F.array().cast("array<string>")
    person = entity_id(F.lit("PERSON"), F.col("author_email"))
    people = G.people(clean).select(person.alias("id"), F.lit("PERSON").alias("type"), "name", none.alias("aliases"), F.lit("").alias("description"), "first_seen", "last_seen", "frequency")
    module = entity_id(F.lit("MODULE"), F.col("module"))
    modules = changes.groupBy("module").agg(F.countDistinct("hash").alias("frequency"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    modules = modules.select(module.alias("id"), F.lit("MODULE").alias("type"), F.col("module").alias("name"), none.alias("aliases"), F.lit("").alias("description"), "first_seen", "last_seen", "frequency")
    owned = G.ownership_relations(G.ownership(changes))
    pairs = G.co_changes(changes)
    a, b = entity_id(F.lit("MODULE"), F.col("module_a")), entity_id(F.lit("MODULE"), F.col("module_b"))
    coupled = pairs.select(
        G.relation_id(F.lit("CO_CHANGED"), a, b).alias("id"), F.lit("CO_CHANGED").alias("type"), a.alias("source_id"), b.alias("target_id"), "weight", F.lit("").alias("first_seen"), F.lit("").alias("last_seen")
    )
    relations = owned.unionByName(coupled).withColumns({"weight": F.col("weight").cast("double"), "description": F.lit(""), "evidence": none})
    return people.unionByName(modules), relations


def ingest(spark: SparkSession, source: str, schema: StructType, store: GraphStore, checkpoint: str, name: str = "commits", depth: int | None = None) -> None:
    """Merge all new files of the folder ``source`` into the store and return."""

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        # Commits that an earlier batch has brought count once.
        fresh = batch.join(store.table("commits").select("hash"), "hash", "left_anti")
        entities, relations = graph_of(fresh, depth)
        store.apply(entities, relations, commits=batch.where("hash is not null"), batch=(name, number))

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
