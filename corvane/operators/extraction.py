"""Entities and relations out of model answers, as expressions; and a rule extractor that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import module_path
from .resolution import ALLOWED

ENTITY_TYPES = ["PERSON", "MODULE", "TECHNOLOGY", "DECISION", "PATTERN"]


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*\n?", ""), r"\n?\s*```\s*$", ""))


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def field(block: Column, tag: str) -> Column:
    """Trimmed text of the first ``tag`` in a block; null where there is none or it is blank. A bare & is text."""
    raw = F.trim(unescape(F.regexp_extract(block, f"(?s)<{tag}>(.*?)</{tag}>", 1)))
    return F.when(raw != "", raw)


def blocks(answer: Column, tag: str) -> Column:
    body = F.regexp_extract(strip_fences(answer), r"(?s)<extraction>(.*)</extraction>", 1)
    return F.regexp_extract_all(body, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def extracted_entities(answers: DataFrame) -> DataFrame:
    """(text_unit_id, name, type, description) from (text_unit_id, answer). Rows without a name or a known type are skipped."""
    rows = answers.select("text_unit_id", F.explode(blocks(F.col("answer"), "entity")).alias("b"))
    out = rows.select("text_unit_id", field(F.col("b"), "name").alias("name"), field(F.col("b"), "type").alias("type"), F.coalesce(field(F.col("b"), "description"), F.lit("")).alias("description"))
    return out.where(F.col("name").isNotNull() & F.col("type").isin(ENTITY_TYPES))


def extracted_relations(answers: DataFrame) -> DataFrame:
    """(text_unit_id, source, target, type, description, weight, seq); weights are 1 to 10, by default 5."""
    rows = answers.select("text_unit_id", F.posexplode(blocks(F.col("answer"), "relation")).alias("seq", "b"))
    f = lambda tag: field(F.col("b"), tag)
    weight = F.least(F.greatest(F.coalesce(f("weight").try_cast("double"), F.lit(5.0)), F.lit(1.0)), F.lit(10.0))
    out = rows.select("text_unit_id", f("source").alias("source"), f("target").alias("target"), f("type").alias("type"), F.coalesce(f("description"), F.lit("")).alias("description"), weight.alias("weight"), "seq")
    return out.where(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("type").isin(list(ALLOWED)))


def typed_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose ends, as far as their unit names them, have types that fit."""
    known = entities.groupBy("text_unit_id", F.lower("name").alias("k")).agg(F.min("type").alias("t"))
    out = relations
    for end in ("source", "target"):
        out = out.withColumn("k", F.lower(end)).join(known.withColumnRenamed("t", f"{end}_type"), ["text_unit_id", "k"], "left").drop("k")
    a, b = F.col("source_type"), F.col("target_type")
    ok = None
    for kind, (s, t) in ALLOWED.items():
        fits = F.coalesce(a == s, F.lit(True)) & F.coalesce(b == t, F.lit(True))
        ok = F.when(F.col("type") == kind, fits) if ok is None else ok.when(F.col("type") == kind, fits)
    return out.where(ok.otherwise(F.lit(True))).drop("source_type", "target_type")


def deduped_relations(relations: DataFrame, order: str = "seq") -> DataFrame:
    """One row per type and ends: the largest weight, the first description."""
    return relations.groupBy("type", "source", "target").agg(F.max("weight").alias("weight"), F.min_by("description", order).alias("description"))


def merged_passes(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of two passes of answers: what both name counts once, with the first pass's words unless they are blank."""
    passes = [a.select("text_unit_id", "answer", F.lit(k).alias("pass")) for k, a in enumerate((first, second))]
    found = [extracted_entities(p).withColumn("pass", F.lit(k)) for k, p in enumerate(passes)]
    order = F.struct((F.col("description") == "").alias("blank"), "pass", "description")
    entities = found[0].unionByName(found[1]).groupBy("text_unit_id", "type", F.lower("name").alias("_k")).agg(F.min_by("name", F.struct("pass", "name")).alias("name"), F.min_by("description", order).alias("description"))
    entities = entities.select("text_unit_id", "name", "type", "description")
    rows = [extracted_relations(p).withColumn("seq", F.col("seq") + k * 1_000_000) for k, p in enumerate(passes)]
    relations = typed_relations(rows[0].unionByName(rows[1]), entities)
    once = relations.groupBy("text_unit_id", "type", "source", "target").agg(F.max("weight").alias("weight"), F.min_by("description", "seq").alias("description"), F.min("seq").alias("seq"))
    return entities, once.select("text_unit_id", "source", "target", "type", "description", "weight", "seq")


def wants_second_pass(commits: Column, entities: Column, min_commits: int = 8, min_share: float = 0.5) -> Column:
    """Whether a unit of many commits gave so few entities that it is read again."""
    return F.coalesce((commits >= min_commits) & (entities / commits < min_share), F.lit(False))


def parsed_summary(c: Column) -> Column:
    """struct(title, summary) of an answer; without the block the whole answer is the summary."""
    body = F.regexp_extract(c, r"(?s)<community_summary>(.*)</community_summary>", 1)
    none = body == ""
    return F.struct(
        F.when(none, F.lit("")).otherwise(F.coalesce(field(body, "title"), F.lit(""))).alias("title"),
        F.when(none, F.trim(c)).otherwise(F.coalesce(field(body, "summary"), F.lit(""))).alias("summary"),
    )


def ask(units: DataFrame, client: Callable[[str], str], retries: int = 1) -> DataFrame:
    """(text_unit_id, answer, failed) of each unit's content. ``client`` runs in the workers; a failing call is repeated, then marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["content"]):
                answer, failed = "", True
                for _ in range(retries + 1):
                    try:
                        answer, failed = client(text or ""), False
                        break
                    except Exception:  # noqa: BLE001 - any client error counts as a failed call
                        continue
                out.append((i, answer, failed))
            yield pd.DataFrame(out, columns=["text_unit_id", "answer", "failed"])

    return units.select("id", "content").mapInPandas(run, "text_unit_id string, answer string, failed boolean")


# Technologies that the rule extractor looks for.
TECHNOLOGIES = ["docker", "graphql", "kafka", "kubernetes", "postgresql", "python", "react", "redis", "rust", "spark", "terraform", "typescript"]


def rule_extraction(units: DataFrame) -> DataFrame:
    """(text_unit_id, name, type, description) without a model: authors of headers, modules of file lines, known technologies."""
    c = F.coalesce("content", F.lit(""))
    authors = F.regexp_extract_all(c, F.lit(r"(?m)^\[[0-9a-f]{7}\] \S+ (.+?)\s*$"), F.lit(1))
    files = F.regexp_extract_all(c, F.lit(r"(?m)^(?:  |--- )(\S+) \+\d+-\d+\s*$"), F.lit(1))
    techs = F.filter(F.array(*map(F.lit, TECHNOLOGIES)), lambda t: F.contains(F.lower(c), t))
    as_rows = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))
    found = F.concat(as_rows(authors, "PERSON"), as_rows(F.transform(files, lambda f: module_path(f)), "MODULE"), as_rows(techs, "TECHNOLOGY"))
    return units.select(F.col("id").alias("text_unit_id"), F.explode(F.array_distinct(found)).alias("e")).select("text_unit_id", "e.name", "e.type", F.lit("").alias("description"))


