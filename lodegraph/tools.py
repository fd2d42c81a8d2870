"""The tools that agents and programs call by name (Q1 to Q5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, resolve_symbols, top_matches
from .operators import traverse


class Engine:
    """A graph behind named tools; each takes keyword arguments and returns a DataFrame."""

    def __init__(self, graph: Graph, name: str = "repository"):
        self.graph, self.name = graph, name
        self.tools: dict[str, Callable[..., DataFrame]] = {}
        for tool in (self.query, self.context, self.impact, self.find_path, self.community, self.list_repos, self.sql):
            self.register(tool.__name__, tool)

    def register(self, name: str, tool: Callable[..., DataFrame]) -> None:
        self.tools[name] = tool

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"unknown tool: {name}")
        return self.tools[name](**arguments)

    def _roots(self, *symbols: str) -> DataFrame:
        asked = self.graph.nodes.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
        return resolve_symbols(self.graph.nodes, asked).where("id is not null")

    def query(self, query: str, kind: str | None = None, file: str | None = None, limit: int = 20) -> DataFrame:
        return top_matches(self.graph.nodes, query, kind, file, limit)

    def context(self, symbol: str, depth: int = 2) -> DataFrame:
        return traverse.context(self.graph.nodes, self.graph.edges, self._roots(symbol).select(F.col("id").alias("root")), depth)

    def impact(self, target: str, direction: str = "downstream", max_depth: int = 5) -> DataFrame:
        return traverse.impact(self.graph.nodes, self.graph.edges, self._roots(target).select(F.col("id").alias("root")), direction, max_depth)

    def find_path(self, source: str, target: str, max_depth: int | None = None) -> DataFrame:
        a, b = (self._roots(s).select(F.col("id").alias(n)) for s, n in ((source, "src"), (target, "dst")))
        return traverse.shortest_paths(self.graph.edges, a.join(b, F.lit(True)), True, max_depth)

    def community(self, symbol: str | None = None, community_id: str | None = None, list_all: bool = False, limit: int = 50) -> DataFrame:
        """Members of all communities, of one, of a symbol's, or the first communities, in this precedence."""
        links = self.graph.edges.where("kind = 'MEMBER_OF'").select(F.col("source_id").alias("node"), F.col("target_id").alias("id"))
        groups = self.graph.nodes.where("kind = 'Community'").select("id", F.col("name").alias("label"))
        sized = groups.join(links.groupBy("id").agg(F.count(F.lit(1)).alias("size")), "id", "left").select("id", "label", F.coalesce("size", F.lit(0)).alias("size"))
        if list_all:
            return sized
        if community_id:
            return links.where(F.col("id") == community_id).join(groups, "id")
        if symbol:
            own = links.join(self._roots(symbol).select(F.col("id").alias("node")), "node").select("id")
            return links.join(own, "id", "left_semi").join(groups, "id")
        return sized.orderBy("id").limit(limit)

    def list_repos(self, detail: bool = False) -> DataFrame:
        told = self.graph.metadata().withColumn("name", F.lit(self.name))
        return told if detail else told.select("name", "node_count", "edge_count")

    def sql(self, query: str) -> DataFrame:
        """A SQL query over ``{nodes}`` and ``{edges}``."""
        return self.graph.nodes.sparkSession.sql(query, nodes=self.graph.nodes, edges=self.graph.edges)

    def resource(self, uri: str) -> str:
        """Q5: ``repos``, or ``repo/<name>/context``: a short text of what there is."""
        if uri != "repos" and not uri.startswith("repo/"):
            raise KeyError(f"unknown resource: {uri}")
        row = self.list_repos(True).first()
        lines = [f"name: {self.name}", f"nodes: {row['node_count']}", f"edges: {row['edge_count']}"]
        if uri != "repos":
            lines += ["languages: " + ", ".join(row["languages"] or []), "kinds:"] + [f"  {k}: {n}" for k, n in sorted((row["node_kinds"] or {}).items())]
        return "\n".join(lines)
