"""Entity resolution of extracted names by leader clustering, and of relation ends by name.

Names are taken in order; each joins the first earlier leader that it equals, abbreviates or resembles
(Jaro-Winkler, not for modules), else it leads. Rows are collapsed to distinct names first, so the
ordered pass of a type is over its vocabulary, not its rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import entity_id, module_path, relation_id
from ..functions.similarity import jaro_winkler
from ..functions.text import BLANKS

# Short names of technologies.
ABBREVIATIONS = {
    "ts": "typescript",
    "js": "javascript",
    "py": "python",
    "rb": "ruby",
    "k8s": "kubernetes",
    "pg": "postgresql",
    "postgres": "postgresql",
    "mongo": "mongodb",
    "es": "elasticsearch",
    "tf": "terraform",
    "gh": "github",
    "gl": "gitlab",
    "gql": "graphql",
    "node": "node.js",
    "react.js": "react",
    "reactjs": "react",
    "vue.js": "vue",
    "vuejs": "vue",
    "next.js": "nextjs",
    "express.js": "express",
    "nuxt.js": "nuxt",
    "svelte.js": "svelte",
}

# Types that a relation may join, source and target.
ALLOWED = {
    "AUTHORED": ("PERSON", "MODULE"),
    "MODIFIED": ("PERSON", "MODULE"),
    "CO_CHANGED": ("MODULE", "MODULE"),
    "DEPENDS_ON": ("MODULE", "MODULE"),
    "USES": ("MODULE", "TECHNOLOGY"),
    "INTRODUCED": ("PERSON", "TECHNOLOGY"),
    "REMOVED": ("PERSON", "TECHNOLOGY"),
    "DECIDED": ("PERSON", "DECISION"),
    "SUPERSEDES": ("DECISION", "DECISION"),
    "EXHIBITS": ("MODULE", "PATTERN"),
}


class _Heads:
    """The leaders so far, as arrays that tell which of them a name may resemble.

    Jaro-Winkler can't exceed what the letters that two names share, their lengths and their first four letters allow;
    a letter counts up to four times by one bit each, further ones together.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold, self.n = threshold, 0
        self.bits, self.rest, self.size, self.start = np.zeros((3, 64), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((4, 64), np.int64)

    @staticmethod
    def _signs(name: str) -> tuple[list[int], int, list[int]]:
        bits, rest = 0, 0
        for c, k in Counter(name).items():
            # 48 slots of four bits; letters that share one only raise the bound.
            slot = 4 * (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 22)
            while k and bits >> slot & 15 != 15:
                bits, k = bits | (bits >> slot & 15) * 2 + 1 << slot, k - 1
            rest += k
        return [bits >> s & (1 << 64) - 1 for s in (0, 64, 128)], rest, [ord(c) for c in name[:4].ljust(4, "\0")]

    def add(self, name: str) -> None:
        if self.n == len(self.size):
            self.bits, self.start = np.tile(self.bits, 2), np.tile(self.start, 2)
            self.rest, self.size = np.tile(self.rest, 2), np.tile(self.size, 2)
        self.bits[:, self.n], self.rest[self.n], self.start[:, self.n] = self._signs(name)
        self.size[self.n] = len(name)
        self.n += 1

    def near(self, name: str, end: int | None, block: int = 8192) -> Iterator[int]:
        """Places, in order and before ``end``, of the leaders that the name may resemble."""
        bits, rest, start = self._signs(name)
        size, end = len(name), self.n if end is None else end
        for lo in range(0, end if size else 0, block):
            at = slice(lo, min(end, lo + block))
            shared = np.minimum(self.rest[at], rest)
            for k in range(3):
                shared += np.bitwise_count(self.bits[k, at] & np.uint64(bits[k]))
            sizes = np.maximum(self.size[at], 1)
            jaro = np.minimum((shared / sizes + shared / size + 1) / 3, 1.0)
            same, prefix = np.ones(len(sizes), bool), np.zeros(len(sizes), np.int64)
            for k in range(4):
                same &= self.start[k, at] == start[k]
                prefix += same
            fits = (jaro + prefix * 0.1 * (1 - jaro) >= self.threshold - 1e-9) & (2 * np.minimum(sizes, size) >= np.maximum(sizes, size)) & (self.size[at] > 0)
            yield from (np.flatnonzero(fits) + lo).tolist()


def leaders(names: list[str], fuzzy: bool, threshold: float) -> list[int]:
    """Index of the leader of each of the sorted distinct names."""
    heads: list[int] = []
    by_form: dict[str, int] = {}
    known = _Heads(threshold)
    out = []
    for i, n in enumerate(names):
        form = ABBREVIATIONS.get(n, n)
        first = by_form.get(form)
        if fuzzy:
            # The first leader in order wins, so a resembling one before the exact one takes the name.
            for h in known.near(n, first):
                if jaro_winkler(n, names[heads[h]]) >= threshold:
                    first = h
                    break
        if first is None:
            first = len(heads)
            heads.append(i)
            by_form.setdefault(form, first)
            if fuzzy:
                known.add(n)
        out.append(heads[first])
    return out


def resolve(extracted: DataFrame, threshold: float = 0.85, module_depth: int | None = None) -> DataFrame:
    """(id, type, name, aliases, description) from (name, type, description)."""
    name = F.when(F.col("type") == "MODULE", module_path(F.col("name"), module_depth)).otherwise(F.col("name"))
    rows = extracted.where("name is not null").select("type", F.btrim(name, F.lit(BLANKS)).alias("name"), F.coalesce("description", F.lit("")).alias("description"))
    longest = F.struct(F.length("description"), "description")
    spelled = rows.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n"), F.max_by("description", longest).alias("description")).withColumn("key", F.lower("name"))
    keys = spelled.select("type", "key").distinct()

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["type"].iloc[0]
        names = sorted(pdf["key"])
        return pd.DataFrame({"type": kind, "key": names, "leader": [names[i] for i in leaders(names, kind != "MODULE", threshold)]})

    led = spelled.join(keys.groupBy("type").applyInPandas(lead, "type string, key string, leader string"), ["type", "key"])
    w = Window.partitionBy("type", "leader").orderBy(F.desc("n"), F.desc(F.length("name")), "name")
    led = led.withColumn("canonical", F.first("name").over(w))
    out = led.groupBy("type", "leader").agg(
        F.first("canonical").alias("name"),
        F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"),
        F.max_by("description", longest).alias("description"),
    )
    return out.select(entity_id(F.col("type"), F.col("name")).alias("id"), "type", "name", "aliases", "description")


def allowed(kind: F.Column, source: F.Column, target: F.Column) -> F.Column:
    """Whether a relation type may join the entity types; unknown relation types may."""
    ok = None
    for k, (a, b) in ALLOWED.items():
        fits = (source == a) & (target == b)
        ok = F.when(kind == k, fits) if ok is None else ok.when(kind == k, fits)
    return ok.otherwise(F.lit(True))


def resolve_relations(extracted: DataFrame, entities: DataFrame, units: DataFrame | None = None, module_depth: int | None = None) -> DataFrame:
    """Relations with ids from (source, target, type, description, weight, text_unit_id) by names.

    Names and aliases match in any case, else the module of the name; of several entities the largest id.
    Ends that aren't found, equal ends and types that don't fit drop the row.
    """
    known = entities.select("id", F.col("type").alias("kind"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    known = known.groupBy(F.lower("n").alias("n")).agg(F.max(F.struct("id", "kind")).alias("e")).where("n is not null")
    out = extracted
    for end in ("source", "target"):
        exact, near = known.select(F.col("n").alias(f"{end}_k"), F.col("e").alias(f"{end}_e")), known.select(F.col("n").alias(f"{end}_m"), F.col("e").alias(f"{end}_f"))
        out = out.withColumn(f"{end}_k", F.lower(end)).withColumn(f"{end}_m", F.lower(module_path(F.col(end), module_depth)))
        out = out.join(exact, f"{end}_k", "left").join(near, f"{end}_m", "left").withColumn(f"{end}_e", F.coalesce(f"{end}_e", f"{end}_f"))
    out = out.where("source_e.id <> target_e.id").where(allowed(F.col("type"), F.col("source_e.kind"), F.col("target_e.kind")))
    cols = [relation_id(F.col("type"), F.col("source_e.id"), F.col("target_e.id")).alias("id"), "type", F.col("source_e.id").alias("source_id"), F.col("target_e.id").alias("target_id"), "weight", "description"]
    if units is None:
        return out.select(*cols, F.lit("").alias("first_seen"), F.lit("").alias("last_seen"))
    dates = units.select(F.col("id").alias("text_unit_id"), "date_start", "date_end")
    out = out.join(dates, "text_unit_id", "left")
    return out.select(*cols, F.coalesce("date_start", F.lit("")).alias("first_seen"), F.coalesce("date_end", F.lit("")).alias("last_seen"))
