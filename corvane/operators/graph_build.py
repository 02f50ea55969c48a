"""The knowledge graph from commits: people, ownership, co-change; and the merge rules of its tables.

Decisions where the semantics leave room: merges own and couple nothing; an ownership edge weighs its
distinct commits; removed and renamed files count as modified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entity_id, module_path, norm_path, relation_id
from ..functions.text import instant


def newest(rows: DataFrame, key: str, order: F.Column, columns: list[str]) -> DataFrame:
    """One row per key: the one with the largest order. Aggregates on the map side, so a hot key is no hot task."""
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return picked.select(key, "r.*")


def clean_commits(commits: DataFrame) -> DataFrame:
    """Newest row per hash: (hash, author_name, author_email, date, parent_hashes, files), without diffs and messages."""
    slim = commits.select(
        "hash",
        F.trim(F.regexp_replace("author_name", r"\s+", " ")).alias("author_name"),
        F.lower(F.trim("author_email")).alias("author_email"),
        "date",
        F.size("parent_hashes").alias("n_parents"),
        F.transform(
            "files_changed", lambda f: F.struct(norm_path(f["path"]).alias("path"), f["status"].alias("status"), f["additions"].alias("additions"), f["deletions"].alias("deletions"))
        ).alias("files"),
        F.coalesce(F.unix_micros(instant("indexed_at")), F.lit(-1)).alias("at"),
    )
    return newest(slim, "hash", F.col("at"), ["author_name", "author_email", "date", "n_parents", "files"])


def file_changes(clean: DataFrame, depth: int | None = None) -> DataFrame:
    """(hash, author_email, date, module, path, status, lines) of commits that aren't merges."""
    rows = clean.where("n_parents <= 1").select("hash", "author_email", "date", F.explode("files").alias("f"))
    return rows.where("f.path is not null").select(
        "hash", "author_email", "date", module_path(F.col("f.path"), depth).alias("module"), "f.path", "f.status", (F.coalesce("f.additions", F.lit(0)) + F.coalesce("f.deletions", F.lit(0))).alias("lines")
    )


def people(clean: DataFrame) -> DataFrame:
    """One person per e-mail address: last name seen, commits, first and last date."""
    own = clean.where("n_parents <= 1 and author_email <> ''")
    return own.groupBy("author_email").agg(
        F.max_by("author_name", F.struct("date", "hash")).alias("name"), F.count(F.lit(1)).alias("frequency"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


def ownership(changes: DataFrame) -> DataFrame:
    """(author_email, module, type, weight, first_seen, last_seen): AUTHORED if the person ever added a file there."""
    # Per commit first: most rows of a hot module vanish before the shuffle.
    per = changes.where("author_email <> ''").groupBy("author_email", "module", "hash").agg(F.max(F.col("status") == "added").alias("added"), F.min("date").alias("date"))
    return per.groupBy("author_email", "module").agg(
        F.when(F.max("added"), "AUTHORED").otherwise("MODIFIED").alias("type"), F.count(F.lit(1)).alias("weight"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


#: Modules of one commit that a task pairs at once; a commit of more is cut, and its slices meet pairwise in spread tasks.
WIDE = 256


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over (module_a, module_b) of each batch of (lm, ll, rm, rl); without a right side the pairs are those of the left."""
    for batch in batches:
        names, codes, lines = pd.Index(sorted({m for side in ("lm", "rm") for x in batch[side] if x is not None for m in x})), [], []
        groups: dict[tuple[int, int], list] = {}
        for lm, ll, rm, rl in zip(batch["lm"], batch["ll"], batch["rm"], batch["rl"]):
            groups.setdefault((len(lm), -1 if rm is None else len(rm)), []).append((lm, ll, rm, rl))
        for (n, k), rows in groups.items():
            step = max(1, 1_000_000 // max(1, n * (n if k < 0 else k)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                left, wl = names.get_indexer(np.concatenate([r[0] for r in part])).reshape(-1, n), np.stack([r[1] for r in part])
                right, wr = (left, wl) if k < 0 else (names.get_indexer(np.concatenate([r[2] for r in part])).reshape(-1, k), np.stack([r[3] for r in part]))
                a, b = np.broadcast_arrays(left[:, :, None], right[:, None, :])
                keep = (a < b) if k < 0 else np.ones(a.shape, bool)
                code = np.minimum(a, b).astype(np.int64) * len(names) + np.maximum(a, b)
                u, inv = np.unique(code[keep], return_inverse=True)
                codes.append(u)
                lines.append((np.bincount(inv, np.minimum(wl[:, :, None], wr[:, None, :])[keep], len(u)), np.bincount(inv, minlength=len(u))))
        if codes:
            u, inv = np.unique(np.concatenate(codes), return_inverse=True)
            weight, n = (np.bincount(inv, np.concatenate([x[j] for x in lines]), len(u)).astype(np.int64) for j in (0, 1))
            yield pd.DataFrame({"module_a": names[u // len(names)], "module_b": names[u % len(names)], "weight": weight, "commits": n})


def co_changes(changes: DataFrame) -> DataFrame:
    """(module_a, module_b, weight, commits): the smaller number of changed lines of each commit, summed up.

    Lines are summed per commit and module first. A task then pairs the modules of many commits in
    arrays and emits one sum per pair it has seen, never the pairs of a commit as rows.
    """
    per = changes.groupBy("hash", "module").agg(F.sum("lines").alias("lines"))
    # Slices by hash of the module bound every list; a commit of few modules is one slice.
    size = per.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("slices"))
    sliced = per.join(size, "hash").groupBy("hash", "slices", F.pmod(F.xxhash64("module"), F.col("slices")).alias("slice"))
    lists = sliced.agg(F.sort_array(F.collect_list(F.struct("module", "lines"))).alias("m")).select("hash", "slices", "slice", F.col("m.module").alias("lm"), F.col("m.lines").alias("ll"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    inner = lists.select("lm", "ll", none("rm", "array<string>"), none("rl", "array<bigint>"))
    wide = lists.where("slices > 1")
    other = wide.select("hash", F.col("slice").alias("slice2"), F.col("lm").alias("rm"), F.col("ll").alias("rl"))
    cross = wide.join(other, "hash").where("slice < slice2").select("lm", "ll", "rm", "rl")
    cross = cross.repartition(changes.sparkSession.sparkContext.defaultParallelism * 2, F.xxhash64("lm", "rm"))
    schema = "module_a string, module_b string, weight long, commits long"
    sums = inner.where(F.size("lm") > 1).mapInPandas(_paired, schema).unionByName(cross.mapInPandas(_paired, schema))
    return sums.groupBy("module_a", "module_b").agg(F.sum("weight").alias("weight"), F.sum("commits").alias("commits"))


def ownership_relations(edges: DataFrame) -> DataFrame:
    person, module = entity_id(F.lit("PERSON"), F.col("author_email")), entity_id(F.lit("MODULE"), F.col("module"))
    return edges.select(relation_id(F.col("type"), person, module).alias("id"), "type", person.alias("source_id"), module.alias("target_id"), "weight", "first_seen", "last_seen")


def edge_density(entities: DataFrame, relations: DataFrame) -> DataFrame:
    v = entities.agg(F.countDistinct("id").alias("n_entities"))
    e = relations.agg(F.countDistinct("id").alias("n_relations"))
    return v.join(e, F.lit(True)).withColumn("density", F.coalesce(F.try_divide(F.col("n_relations").cast("double"), F.col("n_entities") * (F.col("n_entities") - 1)), F.lit(0.0)))


def mentions(units: DataFrame) -> DataFrame:
    """Per entity: units that mention it and the dates they span. ``units``: id, date_start, date_end, entity_ids."""
    pairs = units.select("id", "date_start", "date_end", F.explode("entity_ids").alias("entity_id"))
    return pairs.where("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("id").alias("frequency"), F.min("date_start").alias("first_seen"), F.max("date_end").alias("last_seen"))


# ---- merge rules of the stored tables; rows are applied in the order of (loaded_at, and the row's text for ties) ----


def _said(c: str) -> F.Column:
    return F.nullif(F.col(c), F.lit(""))


def upsert_entities(rows: DataFrame, seq: str = "loaded_at") -> DataFrame:
    """Type, name, aliases, metadata: last writer; a blank description and a null embedding never win; dates min and max; frequency adds up."""
    order = F.struct(F.col(seq), F.to_json(F.struct("name", "aliases", "type")))
    text = F.struct(F.coalesce(F.trim("description") != "", F.lit(False)), F.col(seq), "description")
    return rows.where("id is not null").groupBy("id").agg(
        F.max_by("type", order).alias("type"),
        F.max_by("name", order).alias("name"),
        F.max_by("aliases", order).alias("aliases"),
        F.max_by("description", text).alias("description"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("frequency").alias("frequency"),
        *([F.max_by("metadata", order).alias("metadata")] if "metadata" in rows.columns else []),
        *([F.max_by("embedding", F.struct(F.col("embedding").isNotNull(), F.col(seq))).alias("embedding")] if "embedding" in rows.columns else []),
    )


def upsert_relations(rows: DataFrame, seq: str = "loaded_at") -> DataFrame:
    """Ends: first writer; description and evidence: last; weight adds up; a blank date never wins."""
    order = F.struct(F.col(seq), F.to_json(F.struct("source_id", "target_id", "type", "description", "evidence")))
    return rows.where("id is not null").groupBy("id").agg(
        F.min_by("type", order).alias("type"),
        F.min_by("source_id", order).alias("source_id"),
        F.min_by("target_id", order).alias("target_id"),
        F.sum("weight").alias("weight"),
        F.max_by("description", order).alias("description"),
        F.max_by("evidence", order).alias("evidence"),
        F.coalesce(F.min(_said("first_seen")), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(_said("last_seen")), F.lit("")).alias("last_seen"),
    )


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows and the new rows whose key isn't stored; of new rows that share a key, one stays."""
    fresh = new.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return stored.unionByName(fresh, allowMissingColumns=True)


def junction(owners: DataFrame, list_col: str, entities: DataFrame, owner_name: str) -> DataFrame:
    """(owner, entity_id) pairs of the id lists, without ids that no entity has."""
    pairs = owners.select(F.col("id").alias(owner_name), F.explode(list_col).alias("entity_id")).distinct()
    return pairs.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(owner_name, "entity_id")
