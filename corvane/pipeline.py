"""The whole index in one call: commits to units, entities, relations, communities, summaries and embeddings in a store.

Every stage is a plan over frames; what reaches the driver is counts. A second call with the same store takes
only commits that it doesn't hold, adds to what is there, and finds the communities of the whole graph anew;
summaries of sets that have hardly changed are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions.paths import module_path
from .functions.text import BLANKS
from .operators import analytics, chunking, extraction, graph_algorithms, graph_build as G, resolution
from .session import cut
from .sources.store import GraphStore
from .streaming.ingest import graph_of

STAGES = ["commits", "units", "extraction", "graph", "store", "communities", "summaries", "embeddings"]


def _sets(units: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Units with the sorted ids of the entities that they name."""
    lists = mentioned.groupBy("text_unit_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids")).withColumnRenamed("text_unit_id", "id")
    none = F.array().cast("array<string>")
    return units.join(lists, "id", "left").withColumns({"entity_ids": F.coalesce("entity_ids", none), "relation_ids": none})


def extract(units: DataFrame, client: Callable[[str], str] | None, config: Config) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) as the units' texts name them: by a model where there is one, else by rules.

    Units of many commits and few entities are asked twice; what both passes name counts once.
    """
    if client is None:
        found = extraction.rule_extraction(units)
        return found, units.sparkSession.createDataFrame([], "text_unit_id string, source string, target string, type string, description string, weight double, seq int")
    answers = cut(extraction.ask(units, client, config.retries))
    counts = extraction.extracted_entities(answers).groupBy(F.col("text_unit_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    few = extraction.wants_second_pass(F.size("commit_hashes"), F.coalesce("n", F.lit(0)), config.second_pass_min_commits, config.second_pass_max_share)
    more = cut(extraction.ask(units.join(counts, "id", "left").where(few), client, config.retries))
    return extraction.merged_passes(answers, more)


def build(
    store: GraphStore, commits: DataFrame, config: Config | None = None, client: Callable[[str], str] | None = None,
    embed: Callable[[F.Column], F.Column] | None = None, model: str = "local", full: bool = False, progress: Callable[[str, str, float], None] | None = None,
) -> dict[str, int]:
    """Index the commits that the store lacks. ``embed`` turns a text column into vectors; ``progress`` gets (stage, detail, seconds).

    Returns counts of the run. ``full`` empties the store first.
    """
    config = (config or Config()).checked()
    began = time.time()

    def tell(stage: str, detail: str) -> None:
        if progress:
            progress(stage, detail, time.time() - began)

    if full:
        store.clear()
    if "indexed_at" not in commits.columns:
        commits = commits.withColumn("indexed_at", F.lit(None).cast("string"))
    newest = G.newest(commits, "hash", F.struct(F.coalesce("date", F.lit("")), F.to_json(F.struct("message", "author_name"))), [c for c in commits.columns if c != "hash"])
    fresh = cut(newest.join(store.table("commits").select("hash"), "hash", "left_anti"))
    n_commits = fresh.count()
    counts = {"commits": n_commits, "units": 0, "entities": 0, "relations": 0, "communities": 0, "summarized": 0, "embedded": 0}
    tell("commits", f"{n_commits} new")
    if not n_commits:
        return counts

    units = cut(chunking.chunk(fresh, config.commits_per_unit, config.max_unit_tokens, max_files=config.max_files, max_diff_lines=config.max_diff_lines, max_message=config.max_message))
    counts["units"] = units.count()
    tell("units", f"{counts['units']} of {n_commits} commits")
    named, related = extract(units, client, config)
    named = cut(named.select("text_unit_id", F.btrim("name", F.lit(BLANKS)).alias("name"), "type", "description").where("name <> ''"))
    tell("extraction", f"{named.count()} mentions")

    resolved = cut(resolution.resolve(named, config.resolution_threshold, config.module_depth))
    spelled = resolved.select(F.col("id").alias("entity_id"), "type", F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).select("entity_id", "type", F.lower("n").alias("k")).distinct()
    own = F.when(F.col("type") == "MODULE", module_path(F.col("name"), config.module_depth)).otherwise(F.col("name"))
    mentioned = cut(named.select("text_unit_id", "type", F.lower(own).alias("k")).join(spelled, ["type", "k"]).select("text_unit_id", "entity_id").distinct())
    dated = units.select(F.col("id").alias("text_unit_id"), "date_start", "date_end").join(mentioned, "text_unit_id")
    seen = dated.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("frequency"), F.min("date_start").alias("first_seen"), F.max("date_end").alias("last_seen"))
    from_text = resolved.join(seen, "id").select("id", "type", "name", "aliases", "description", "first_seen", "last_seen", "frequency")
    counted, owned = graph_of(fresh, config.module_depth)
    # An entity that both know has the texts' description and both frequencies.
    entities = G.upsert_entities(counted.withColumn("loaded_at", F.lit(0)).unionByName(from_text.withColumn("loaded_at", F.lit(1))))
    ends = resolution.resolve_relations(related, resolved, units, config.module_depth)
    evidence = F.array().cast("array<string>")
    relations = owned.unionByName(ends.withColumn("evidence", evidence).select(*owned.columns))
    relations = G.upsert_relations(relations.withColumn("loaded_at", F.lit(0)))
    tell("graph", "merged")
    last = fresh.agg(F.max_by("hash", F.struct("date", "hash"))).first()[0]
    store.apply(entities, relations, _sets(units, mentioned), fresh, meta={"last_indexed_commit": last})
    counts |= {"entities": store.table("entities").count(), "relations": store.table("relations").count()}
    tell("store", f"{counts['entities']} entities, {counts['relations']} relations")

    old = cut(store.table("communities"))
    all_entities, all_relations = store.table("entities"), store.table("relations")
    found = cut(graph_algorithms.community_levels(all_entities, cut(graph_algorithms.projection(all_entities, all_relations)), config.resolutions, config.min_community, config.parent_link))
    counts["communities"] = found.count()
    tell("communities", f"{counts['communities']} at {len(config.resolutions)} resolutions")
    kept = graph_algorithms.reused_summaries(found, old, config.summary_reuse).select("id", "title", "summary")
    anew = cut(summarized(found.join(kept, "id", "left_anti"), all_entities, client, config.retries))
    counts["summarized"] = anew.count()
    whole = found.join(kept.unionByName(anew), "id", "left").select("id", "level", "title", "summary", "entity_ids", "parent_id", "child_ids")
    whole = cut(whole)
    store.clear(only_communities=True)
    store.apply(communities=whole)
    tell("summaries", f"{counts['summarized']} new")

    if embed is not None:
        counts["embedded"] = embed_changed(store, embed, model)
        tell("embeddings", f"{counts['embedded']} new")
    return counts


def summarized(communities: DataFrame, entities: DataFrame, client: Callable[[str], str] | None, retries: int = 1) -> DataFrame:
    """(id, title, summary): by a model, or by the names of the most frequent members."""
    members = analytics.community_members(communities, entities)
    lists = members.groupBy(F.col("community_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    rows = communities.select("id", F.size("entity_ids").alias("n")).join(lists, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    title = F.coalesce(F.element_at("names", 1), F.col("id"))
    text = F.concat(F.col("n").cast("string"), F.lit(" entities around "), F.array_join("names", ", "))
    if client is None:
        return rows.select("id", title.alias("title"), text.alias("summary"))
    answers = extraction.ask(rows.select("id", text.alias("content")), client, retries).where("not failed")
    return answers.select(F.col("text_unit_id").alias("id"), extraction.parsed_summary(F.col("answer")).alias("s")).select("id", "s.title", "s.summary")


def embed_changed(store: GraphStore, embed: Callable[[F.Column], F.Column], model: str) -> int:
    """Embed the entities and communities whose text has changed since it was embedded. Returns their number."""
    e = store.table("entities").select("id", F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))).alias("text"))
    c = store.table("communities").select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("text"))
    texts = e.unionByName(c)
    if store.manifest()["meta"].get("embedding_model", model) != model:
        todo = analytics.embedding_delta(texts, store.table("embeddings").limit(0))
    else:
        todo = analytics.embedding_delta(texts, store.table("embeddings"))
    rows = cut(texts.join(todo.select("id", "text_hash"), "id").select("id", "text_hash", embed(F.col("text")).cast("array<float>").alias("embedding")))
    store.put_embeddings(rows, model)
    return rows.count()

