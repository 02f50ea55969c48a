"""Questions to the graph: experts, coupling, silos, cards, exports, reports.

All inputs are plain frames: ``entities`` (id, type, name, aliases, description, first_seen, last_seen,
frequency) and ``relations`` (id, type, source_id, target_id, weight, first_seen, last_seen), each with
unique ids. Time is always the ``as_of`` argument. Every top-k ends with an id, so ties have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import instant, js_round
from .chunking import numbered

OWNING = ["AUTHORED", "MODIFIED"]

#: Slices in which a decision gets the modules of its makers.
SLICES = 64

#: Where no community has more members, the pairs of members are looked up in all of them.
PAIRED = 100


def days_between(as_of: str, c: Column) -> Column:
    """Days, with fractions, from an ISO date string to ``as_of``; null where it can't be read."""
    return (F.unix_micros(instant(F.lit(as_of))) - F.unix_micros(instant(c))) / F.lit(86_400_000_000.0)


def modules_at(entities: DataFrame, path: str) -> DataFrame:
    """Modules whose name is the path or lies beneath it."""
    return entities.where((F.col("type") == "MODULE") & ((F.col("name") == path) | F.col("name").startswith(path + "/")))


def experts(entities: DataFrame, relations: DataFrame, path: str, as_of: str, top: int = 5) -> DataFrame:
    mods = modules_at(entities, path).select(F.col("id").alias("target_id"), "frequency")
    owned = relations.where(F.col("type").isin(OWNING)).join(mods.select("target_id"), "target_id", "left_semi")
    per = owned.groupBy("source_id").agg(F.sum("weight").alias("weight"), F.max("last_seen").alias("last_active"), F.countDistinct("target_id").alias("n_modules"))
    people = entities.where("type = 'PERSON'").select(F.col("id").alias("source_id"), "name")
    total = mods.agg(F.coalesce(F.nullif(F.sum("frequency"), F.lit(0)), F.lit(1)).alias("total"))
    days = F.coalesce(days_between(as_of, F.col("last_active")), F.lit(365.0))
    rows = per.join(people, "source_id").join(F.broadcast(total), F.lit(True))
    return rows.select(
        F.col("source_id").alias("person_id"),
        "name",
        js_round(F.col("weight") * (1 / (1 + days / 365)), 2).alias("score"),
        F.round("weight", 6).alias("weight"),
        js_round(F.col("weight") / F.col("total"), 4).alias("share"),
        "last_active",
        "n_modules",
    ).orderBy(F.desc("score"), "person_id").limit(top)


def with_bars(ranked: DataFrame, score: str = "score", width: int = 20) -> DataFrame:
    """Percent of the best score and a bar of that length. For ranked results, which are short."""
    best = F.max(score).over(Window.partitionBy(F.lit(1)))
    pct = F.when(best > 0, js_round(F.col(score) / best * 100, 0)).otherwise(F.lit(0.0)).cast("int")
    return ranked.withColumn("percent", pct).withColumn("bar", F.repeat(F.lit("#"), js_round(pct / 100 * width, 0).cast("int")))


def coupling(entities: DataFrame, relations: DataFrame, path: str, min_weight: float = 2) -> DataFrame:
    mods = modules_at(entities, path).select("id", "frequency")
    ids = mods.select("id")
    pairs = relations.where("type = 'CO_CHANGED'").select("source_id", "target_id", "weight")
    # Both directions; a pair inside the set has both ends in it and drops out.
    out = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight").unionByName(
        pairs.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "weight")
    )
    outside = out.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("other")), "other", "left_anti")
    coupled = outside.groupBy("other").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= min_weight)
    names = entities.select(F.col("id").alias("source_id"), "name").where("name <> ''")
    owned = relations.where(F.col("type").isin(OWNING)).select("source_id", F.col("target_id").alias("other"))
    mine = owned.join(ids.select(F.col("id").alias("other")), "other", "left_semi").join(names, "source_id").select("name").distinct()
    shared = owned.join(coupled.select("other"), "other", "left_semi").join(names, "source_id").join(mine, "name", "left_semi").groupBy("other").agg(F.countDistinct("name").alias("shared_authors"))
    total = mods.agg(F.sum("frequency").alias("total"))
    there = entities.select(F.col("id").alias("other"), "name")
    return (
        coupled.join(there, "other").join(shared, "other", "left").join(F.broadcast(total), F.lit(True))
        .select(
            F.col("other").alias("module_id"), "name", F.round("weight", 6).alias("weight"),
            F.round(F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0), 6).alias("co_change_ratio"),
            F.coalesce("shared_authors", F.lit(0)).alias("shared_authors"),
        )
    )


def silos(entities: DataFrame, relations: DataFrame, as_of: str, min_frequency: int = 3, inactive_days: int = 180) -> DataFrame:
    """Modules that at most one person still works on."""
    mods = entities.where((F.col("type") == "MODULE") & (F.col("frequency") >= min_frequency)).select("id", "name", "frequency")
    owned = relations.where(F.col("type").isin(OWNING)).select(
        F.col("target_id").alias("id"), "source_id", "last_seen", (days_between(as_of, F.col("last_seen")) <= inactive_days).alias("active")
    )
    per = owned.groupBy("id").agg(
        F.countDistinct(F.when(F.col("active"), F.col("source_id"))).alias("n"), F.min(F.when(F.col("active"), F.col("source_id"))).alias("solo"), F.max("last_seen").alias("last_activity")
    )
    rows = mods.join(per, "id", "left").withColumn("active_experts", F.coalesce("n", F.lit(0)))
    return rows.where("active_experts <= 1").select(F.col("id").alias("module_id"), "name", "frequency", "active_experts", F.col("solo").alias("solo_expert"), F.coalesce("last_activity", F.lit("")).alias("last_activity"))


def risk(silo_rows: DataFrame) -> DataFrame:
    return silo_rows.agg(F.count_if(F.col("active_experts") == 0).alias("orphans"), F.count_if(F.col("active_experts") == 1).alias("silos"))


def relations_of(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations at either end of the ids, with direction; a self loop comes twice."""
    cols = [F.col(c) for c in ("id", "type", "weight", "last_seen")]
    out = relations.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other_id"), F.lit("out").alias("direction"), *cols)
    into = relations.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other_id"), F.lit("in").alias("direction"), *cols)
    return out.unionByName(into)


def cards(entities: DataFrame, relations: DataFrame, ids: DataFrame, top: int = 50) -> DataFrame:
    """The heaviest relations of each entity, the other end's name, and how many more there are."""
    rel = relations_of(relations, ids)
    total = rel.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "id", "direction")
    best = rel.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    names = entities.select(F.col("id").alias("other_id"), "name")
    return best.join(names, "other_id", "left").join(total, "entity_id").select(
        "entity_id", "place", "direction", "type", F.col("id").alias("relation_id"), "other_id", F.coalesce("name", "other_id").alias("other_name"), F.round("weight", 6).alias("weight"), F.greatest(F.col("n") - top, F.lit(0)).alias("hidden")
    )


def degrees(relations: DataFrame) -> DataFrame:
    """Relation ends per entity, parallel edges and both ends of a loop counted."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return ends.where("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def export_nodes(entities: DataFrame, communities: DataFrame, max_nodes: int = 500) -> DataFrame:
    """The most frequent entities with their smallest community of level 0."""
    nodes = entities.orderBy(F.desc("frequency"), "id").limit(max_nodes).select("id", "type", "name", "frequency")
    home = communities.where("level = 0").select(F.col("id").alias("c"), F.explode("entity_ids").alias("id")).groupBy("id").agg(F.min("c").alias("community_id"))
    size = F.lit(1.8) + F.least(F.lit(5.2), F.ln(F.col("frequency") + 1) * 1.5)
    return nodes.join(home, "id", "left").withColumn("size", F.round(size, 6))


def export_edges(nodes: DataFrame, relations: DataFrame, max_edges: int = 2000) -> DataFrame:
    """Edges among the nodes, the heaviest of each unordered pair, and whether they leave a community."""
    a, b = nodes.select(F.col("id").alias("source_id"), F.col("community_id").alias("ca")), nodes.select(F.col("id").alias("target_id"), F.col("community_id").alias("cb"))
    kept = relations.where("source_id <> target_id").join(F.broadcast(a), "source_id").join(F.broadcast(b), "target_id")
    pair = kept.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(
        F.max_by(F.struct("id", "type", "source_id", "target_id", "weight", "ca", "cb"), F.struct("weight", F.reverse(F.col("id")))).alias("e")
    )
    e = pair.select("e.*").orderBy(F.desc("weight"), "id").limit(max_edges)
    cross = F.coalesce(F.col("ca") != F.col("cb"), F.lit(False))
    return e.select(F.col("id").alias("relation_id"), "type", "source_id", "target_id", F.round("weight", 6).alias("weight"), cross.alias("cross_community"))


def export_counts(entities: DataFrame, nodes: DataFrame, relations: DataFrame, max_edges: int = 2000) -> DataFrame:
    """(shown_nodes, total_nodes, shown_edges, total_edges): what the caps of the export leave out; edges are pairs among the shown nodes."""
    ids = nodes.select("id")
    kept = relations.where("source_id <> target_id").join(F.broadcast(ids.select(F.col("id").alias("source_id"))), "source_id", "left_semi").join(F.broadcast(ids.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    pairs = kept.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().agg(F.count(F.lit(1)).alias("total_edges"))
    counts = entities.agg(F.countDistinct("id").alias("total_nodes")).join(nodes.agg(F.count(F.lit(1)).alias("shown_nodes")), F.lit(True)).join(pairs, F.lit(True))
    return counts.select("shown_nodes", "total_nodes", F.least("total_edges", F.lit(max_edges)).alias("shown_edges"), "total_edges")


# Colours that communities take in turn.
COLOURS = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac"]


def community_colours(communities: DataFrame) -> DataFrame:
    """(id, title, colour) of the communities of level 0, in the order of their ids."""
    own = communities.where("level = 0").select("id", "title")
    placed = numbered(own, [F.col("id")])
    return placed.select("id", "title", F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("pos") % len(COLOURS) + 1).cast("int")).alias("colour"))


def by_ids(rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """The rows of the ids, each id once however often it is asked for."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids) if i is not None], f"{key} string")
    return rows.join(F.broadcast(wanted), key, "left_semi")


def owners_of(junction: DataFrame, owners: DataFrame, owner: str, entity_ids: DataFrame) -> DataFrame:
    """(entity_id, and the owner's columns) of the units or communities that hold each entity, through the stored junction (``owner``, entity_id)."""
    pairs = junction.join(entity_ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return pairs.withColumnRenamed(owner, "id").join(owners, "id").select("entity_id", *owners.columns)


def token_estimate(units: DataFrame, n_communities: int, per_unit: int = 1100, passes: float = 1.4, per_community: int = 800) -> DataFrame:
    """(n_units, extraction_tokens, summary_tokens, total_tokens, input_tokens, output_tokens) of building the index once."""
    t = units.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.sum(F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4)), F.lit(0)).alias("t"))
    t = t.select("n_units", F.floor((F.col("t") + F.col("n_units") * per_unit) * passes + 0.5).alias("extraction_tokens"), F.lit(n_communities * per_community).cast("long").alias("summary_tokens"))
    t = t.withColumn("total_tokens", F.col("extraction_tokens") + F.col("summary_tokens"))
    return t.withColumns({"input_tokens": F.round(F.col("total_tokens") * 0.6, 3), "output_tokens": F.round(F.col("total_tokens") * 0.4, 3)})


def actual_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``cost`` to (provider, model, input_tokens, output_tokens): the model's rate, else the provider's, else nothing.

    ``rates``: (name, input, output) a million tokens, by name of model or provider; it is the caller's.
    """
    r = lambda p: rates.select(F.col("name").alias(f"{p}_name"), F.struct("input", "output").alias(p))
    out = usage.join(r("m"), F.col("model") == F.col("m_name"), "left").join(r("p"), F.col("provider") == F.col("p_name"), "left")
    rate = F.coalesce("m", "p", F.struct(F.lit(0.0).alias("input"), F.lit(0.0).alias("output")))
    cost = (F.col("input_tokens") * rate["input"] + F.col("output_tokens") * rate["output"]) / 1_000_000
    return out.withColumn("cost", cost).select(*usage.columns, "cost")


def type_breakdown(entities: DataFrame, top: int = 5) -> DataFrame:
    counts = entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("frequency"), "id")
    best = entities.select("type", "id", "name", "frequency", F.row_number().over(w).alias("k")).where(F.col("k") <= top)
    names = best.groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), "|").alias("examples"))
    return counts.join(names, "type").select("type", "n", "examples")


def graph_summary(communities: DataFrame, top: int = 10) -> DataFrame:
    """The first communities of the highest level of 0 to 2 that has any."""
    level = communities.where("level <= 2").agg(F.max("level").alias("level"))
    return communities.join(F.broadcast(level), "level").orderBy("id").limit(top).select("id", "level", "title")


def community_members(communities: DataFrame, entities: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent members of each community."""
    m = communities.select(F.col("id").alias("community_id"), F.explode("entity_ids").alias("id")).distinct().join(entities.select("id", "name", "frequency"), "id")
    w = Window.partitionBy("community_id").orderBy(F.desc("frequency"), "name", "id")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("community_id", "place", F.col("id").alias("entity_id"), "name", "frequency")


def latest_commits(units: DataFrame, commits: DataFrame, top: int = 10) -> DataFrame:
    """The latest commits of each entity, through the units that mention it."""
    pairs = units.select(F.explode("entity_ids").alias("entity_id"), "commit_hashes").select("entity_id", F.explode("commit_hashes").alias("hash")).distinct()
    rows = pairs.join(commits.select("hash", "date"), "hash")
    w = Window.partitionBy("entity_id").orderBy(F.desc("date"), "hash")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("entity_id", "place", "hash", "date")


def decisions(entities: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Timeline of decisions: who took them, what they replace, which modules their makers work on.

    ``wanted``: ids of decisions. Rows (decision_id, first_seen, role, other_id).
    """
    d = entities.where("type = 'DECISION'").join(wanted.select("id"), "id", "left_semi").select(F.col("id").alias("decision_id"), "first_seen")
    made = relations.where("type = 'DECIDED'").select(F.col("target_id").alias("decision_id"), F.col("source_id").alias("other_id"))
    newer = relations.where("type = 'SUPERSEDES'").select(F.col("source_id").alias("decision_id"), F.col("target_id").alias("other_id"))
    makers = d.join(made, "decision_id").distinct()
    worked = relations.where(F.col("type").isin(OWNING)).select(F.col("source_id").alias("other_id"), F.col("target_id").alias("module"))
    # Modules go in lists, a slice each by hash, so that a decision's makers meet by slices instead of modules.
    lists = worked.groupBy("other_id", F.pmod(F.xxhash64("module"), F.lit(SLICES)).alias("slice")).agg(F.collect_set("module").alias("s"))
    modules = makers.join(lists, "other_id").groupBy("decision_id", "first_seen", "slice").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    modules = modules.select("decision_id", "first_seen", F.explode("s").alias("other_id"))
    return (
        makers.select("decision_id", "first_seen", F.lit("maker").alias("role"), "other_id")
        .unionByName(d.join(newer, "decision_id").select("decision_id", "first_seen", F.lit("supersedes").alias("role"), "other_id").distinct())
        .unionByName(modules.select("decision_id", "first_seen", F.lit("module").alias("role"), "other_id"))
    )


def summary_inputs(communities: DataFrame, relations: DataFrame) -> DataFrame:
    """Members of each community and its relations with either end inside.

    A community's relations are the sum over its members, less those with both ends inside, which the sum has twice;
    only these are joined: by the pairs of its members or by its members' relations, whichever are fewer.
    """
    m = communities.select(F.col("id").alias("community_id"), F.explode("entity_ids").alias("member")).distinct()
    pairs = relations.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a is not null and b is not null")
    ends = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("member"), "n")
    degree = ends.groupBy("member").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    size = m.join(degree, "member", "left").groupBy("community_id").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("ends"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("steps")
    )
    known, large = m.where("member is not null"), not communities.where(F.size("entity_ids") > PAIRED).isEmpty()
    if large:
        by = size.select("community_id", (F.col("members") * (F.col("members") - 1) / 2 <= F.greatest("steps", F.lit(PAIRED * PAIRED))).alias("by_pairs"))
        known = known.join(by, "community_id")
    # A list is as short as PAIRED, or has fewer pairs than its community's relations.
    few = (known.where("by_pairs") if large else known).groupBy("community_id").agg(F.array_sort(F.collect_list("member")).alias("s"))
    few = few.select("community_id", "s", F.posexplode("s").alias("at", "a")).select("community_id", "a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
    few = few.join(pairs, ["a", "b"]).select("community_id", "n")
    if large:
        many = known.where("not by_pairs").select("community_id", "member")
        held = many.select("community_id", F.col("member").alias("a")).join(pairs.where("a <> b"), "a")
        few = few.unionByName(held.join(many.withColumnRenamed("member", "b"), ["community_id", "b"]).select("community_id", "n"))
    twice = few.groupBy("community_id").agg(F.sum("n").alias("twice"))
    return size.join(twice, "community_id", "left").select("community_id", "members", (F.col("ends") - F.coalesce("twice", F.lit(0))).alias("relations"))


def embedding_delta(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, text_hash, state) of texts to embed anew: ``current`` (id, text) against ``stored`` (id, text_hash)."""
    now = current.select("id", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"))
    both = now.join(stored.select("id", F.col("text_hash").alias("old")), "id", "left")
    return both.where(~F.col("text_hash").eqNullSafe(F.col("old"))).select("id", "text_hash", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("state"))
