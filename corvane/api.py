"""The engine as functions over a graph of frames, and a small command line.

    python -m corvane.api scan STORE REPOSITORY
    python -m corvane.api experts DIR src
    python -m corvane.api ask DIR "who maintains the decoder"

DIR holds the tables of the graph as parquet, or is the folder of a ``GraphStore``.
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, pipeline
from .functions import render
from .functions.query_text import classify
from .operators import analytics, graph_algorithms, search
from .plans import questions
from .session import local_session, table
from .sources import git
from .sources.store import GraphStore


@dataclass
class Graph:
    """Clean tables of one graph; every method returns a DataFrame or plain Python values."""

    entities: DataFrame
    relations: DataFrame
    communities: DataFrame
    units: DataFrame
    as_of: str

    @classmethod
    def read(cls, spark: SparkSession, folder: str, as_of: str = questions.AS_OF) -> Graph:
        """Of raw tables: the newest row of each record is found anew by every question."""
        u = table(spark, folder, "text_units").groupBy("id").agg(F.max("content").alias("content"), F.max("date_end").alias("date_end"), F.max("entity_ids").alias("entity_ids"))
        c = questions.communities(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>"))
        return cls(questions.entities(spark, folder), questions.relations(spark, folder), c, u, as_of)

    @classmethod
    def of(cls, store: GraphStore, as_of: str = questions.AS_OF) -> Graph:
        """Of a store: its rows are clean, so questions only scan them."""
        e, c, vectors = store.table("entities"), store.table("communities"), store.table("embeddings").select("id", F.col("embedding").alias("_v"))

        def embedded(df: DataFrame) -> DataFrame:
            both = df.join(vectors, "id", "left")
            own = F.coalesce("embedding", "_v") if "embedding" in df.columns else F.col("_v")
            return both.withColumn("embedding", own).drop("_v")

        return cls(embedded(e), store.table("relations"), embedded(c), store.table("text_units").select("id", "content", "date_end", "entity_ids"), as_of)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, as_of: str = questions.AS_OF) -> Graph:
        store = GraphStore(spark, folder)
        return cls.of(store, as_of) if store.manifest()["version"] else cls.read(spark, folder, as_of)

    def experts(self, path: str, top: int = 5) -> DataFrame:
        return analytics.with_bars(analytics.experts(self.entities, self.relations, path, self.as_of, top))

    def coupling(self, path: str, min_weight: float = 2) -> DataFrame:
        return analytics.coupling(self.entities, self.relations, path, min_weight).orderBy("weight", "module_id", ascending=[False, True])

    def silos(self, min_frequency: int = 3, inactive_days: int = 180) -> DataFrame:
        return analytics.silos(self.entities, self.relations, self.as_of, min_frequency, inactive_days).orderBy("active_experts", "frequency", "module_id", ascending=[True, False, True])

    def path(self, start: str, end: str, max_depth: int = 5) -> list[str] | None:
        return graph_algorithms.shortest_path(self.relations.selectExpr("source_id a", "target_id b"), start, end, max_depth)

    def path_relations(self, start: str, end: str, max_depth: int = 5) -> DataFrame:
        """The relation of each step of a shortest path; no rows without a path."""
        return graph_algorithms.path_edges(self.relations, self.path(start, end, max_depth) or []).orderBy("step")

    def entity(self, query: str) -> str | None:
        row = search.lookup(self.entities, self.entities.sparkSession.createDataFrame([(query,)], "query string")).head()
        if row:
            return row["entity_id"]
        row = search.bm25(search.entity_texts(self.entities), "id", search.ENTITY_WEIGHTS, query).orderBy("score", "id", ascending=[False, True]).head()
        return row["id"] if row else None

    def card(self, query: str, top: int = 50) -> DataFrame:
        found = self.entity(query)
        return analytics.cards(self.entities, self.relations, self.entities.where(self.entities.id == found).select("id"), top)

    def detail(self, query: str) -> dict | None:
        """An entity with its relations, the communities and the units that hold it."""
        found = self.entity(query)
        if found is None:
            return None
        holds = F.array_contains("entity_ids", found)
        row = self.entities.where(F.col("id") == found).drop("embedding").head()
        return row.asDict() | {
            "relations": [r.asDict() for r in self.card(found).orderBy("place").collect()],
            "communities": [r.asDict() for r in self.communities.where(holds).select("id", "level", "title").orderBy("level", "id").limit(50).collect()],
            "units": [r["id"] for r in self.units.where(holds).orderBy(F.desc("date_end"), "id").select("id").limit(50).collect()],
        }

    def decisions(self, topic: str, top: int = 20) -> DataFrame:
        """Timeline of the decisions that the topic names; where none does, of those near the entities that it names."""
        about = self.entities.where("type = 'DECISION'")
        best = lambda df: search.bm25(search.entity_texts(df), "id", search.ENTITY_WEIGHTS, topic).orderBy(F.desc("score"), "id").limit(top).select("id")
        hits = best(about)
        if hits.isEmpty():
            near = analytics.relations_of(self.relations, best(self.entities)).select(F.col("other_id").alias("id")).distinct()
            hits = about.join(near, "id", "left_semi").select("id")
        return analytics.decisions(self.entities, self.relations, hits)

    def ask(self, question: str, **limits) -> dict:
        if classify(question) == "global":
            rows = search.global_search(self.communities, question, top=limits.get("top", 5)).collect()
            return {"kind": "global", "communities": [r.asDict() for r in rows]}
        return {"kind": "local"} | search.local_search(self.entities, self.relations, self.units, self.communities, question, self.as_of, **limits)

    def export(self, max_nodes: int = 500, max_edges: int = 2000) -> dict:
        """Nodes, edges and coloured communities for a viewer, and what the caps leave out."""
        nodes = analytics.export_nodes(self.entities, self.communities, max_nodes)
        out = {"nodes": nodes, "edges": analytics.export_edges(nodes, self.relations, max_edges)}
        shown = nodes.select(F.col("community_id").alias("id")).where("id is not null").distinct()
        out["communities"] = analytics.community_colours(self.communities).join(F.broadcast(shown), "id", "left_semi").orderBy("id")
        counts = analytics.export_counts(self.entities, nodes, self.relations, max_edges).head().asDict()
        cut = counts["shown_nodes"] < counts["total_nodes"] or counts["shown_edges"] < counts["total_edges"]
        return {k: [r.asDict() for r in df.collect()] for k, df in out.items()} | {"truncated": counts if cut else None}

    # ---- resources: short texts about the whole graph ----

    def stats(self) -> dict[str, int]:
        return {n: df.count() for n, df in (("entities", self.entities), ("relations", self.relations), ("communities", self.communities), ("units", self.units))}

    def types(self) -> DataFrame:
        return analytics.type_breakdown(self.entities).orderBy("type")

    def summary(self, top: int = 10) -> DataFrame:
        return analytics.graph_summary(self.communities, top).orderBy("id")

    def resource(self, name: str) -> str:
        """'stats', 'types' or 'summary' as markdown."""
        rows = [self.stats()] if name == "stats" else [r.asDict() for r in {"types": self.types, "summary": self.summary}[name]().collect()]
        return render.markdown(rows, name.capitalize())


#: Rows that the command line shows of a long result.
SHOWN = 200
_COMMANDS = {
    "experts": ["path"], "coupling": ["path"], "silos": [], "card": ["query"], "detail": ["query"], "path": ["start", "end"], "path_relations": ["start", "end"],
    "decisions": ["topic"], "ask": ["question"], "export": [], "stats": [], "resource": ["name"], "reset": [], "scan": ["repository"],
}


def scan(store: GraphStore, repository: str, **given) -> dict[str, int]:
    """Index what a git repository has beyond the store."""
    c = config.load(repo=repository, storage=store.folder, **given)
    store.spark.dataSource.register(git.GitLog)
    options = {"path": c.repo, "branch": c.branch} | ({"since_commit": at} if (at := store.manifest()["meta"].get("last_indexed_commit")) else {})
    log = store.spark.read.format("gitlog").options(**options).load()
    rows = git.commits(log, c.max_commits).drop("seq").withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return pipeline.build(store, rows, c)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--format", choices=["json", "markdown"], default="json")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in _COMMANDS.items():
        q = sub.add_parser(name)
        q.add_argument("folder")
        for a in args:
            q.add_argument(a)
    a = vars(p.parse_args(argv))
    command, folder, form = a.pop("command"), os.path.abspath(a.pop("folder")), a.pop("format")
    spark = SparkSession.getActiveSession() or local_session()
    if command == "reset":
        GraphStore(spark, folder).clear()
        found = {"cleared": folder}
    elif command == "scan":
        found = scan(GraphStore(spark, folder), a["repository"])
    else:
        found = getattr(Graph.open(spark, folder), command)(*a.values())
    if isinstance(found, DataFrame):
        found = [r.asDict() for r in found.limit(SHOWN).collect()]
    if isinstance(found, str):
        print(found)
    elif form == "markdown" and isinstance(found, list):
        print(render.markdown(found if not found or isinstance(found[0], dict) else [{"value": x} for x in found]))
    else:
        print(json.dumps(found, ensure_ascii=False, default=str, indent=1))


if __name__ == "__main__":
    main()
