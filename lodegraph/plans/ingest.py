"""From source files to the whole graph, and its analysis."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_id
from ..graph import Graph
from ..operators import calls, community, extract, heritage, imports, process, types
from ..operators.iterate import cut
from ..sources.language import detect

Progress = Callable[[str, float], None]


def build(files: DataFrame, aliases: list[tuple[str, str]] | None = None, on_progress: Progress | None = None) -> Graph:
    """The graph of ``files`` (``path``, ``content``): structure, symbols, imports, calls, inheritance."""
    tell = on_progress or (lambda phase, done: None)
    known = cut(files.select("path", "content", detect(F.col("path"), F.col("content"))["language"].alias("language")))
    tell("structure", 0.1)
    file_nodes, contains = extract.structure(known)
    code = known.where("content is not null and language is not null")
    found = cut(extract.symbols(code))
    tell("parsing", 0.3)
    resolved = cut(imports.resolve_imports(extract.imports(code), imports.numbered(known), aliases))
    tell("imports", 0.5)
    links = resolved.where("resolved_path is not null").select(F.col("file_path").alias("from_file"), F.col("resolved_path").alias("to_file"))
    sites = cut(extract.call_sites(code, found))
    owner = found.select(F.col("id").alias("source_id"), F.col("parent_id"))
    owners = owner.join(found.where("kind = 'Class'").select(F.col("id").alias("parent_id"), F.col("name").alias("enclosing_class")), "parent_id", "left").select("source_id", "enclosing_class")
    typed = calls.receiver_types(sites.join(owners, "source_id", "left"), types.type_env(code), found)
    call_edges = calls.call_edges(calls.resolve(typed, found, links))
    tell("calls", 0.7)
    inherits = heritage.heritage_edges(clauses_of(found), found, links)
    tell("heritage", 0.9)
    nodes = file_nodes.unionByName(found.drop("parent_id", "indent", "declaration", "parameter_count"), allowMissingColumns=True)
    edges = contains
    for more in (extract.defines(found), imports.import_edges(resolved), call_edges.drop("n_sites"), inherits):
        edges = edges.unionByName(more, allowMissingColumns=True)
    return Graph.of(nodes, edges)


def clauses_of(found: DataFrame) -> DataFrame:
    """What the classes and interfaces among extracted symbols extend and implement."""
    clause = heritage.class_clause(F.col("declaration"), F.col("language"))
    kinds = found.where(F.col("kind").isin("Class", "Interface"))
    return kinds.select("id", "file_path", (F.col("kind") == "Interface").alias("is_interface"), clause["extends"].alias("extends"), clause["implements"].alias("implements"))


class Heritage:
    """Inheritance over files that come bit by bit. Symbols and imports may be added from elsewhere; parents are looked
    for among all that has been added when the edges are asked for, whatever came first."""

    def __init__(self) -> None:
        self._symbols: list[DataFrame] = []
        self._imports: list[DataFrame] = []
        self._clauses: list[DataFrame] = []

    def add_symbols(self, symbols: DataFrame) -> Heritage:
        """``id``, ``kind``, ``name``, ``file_path``, ``ord``."""
        self._symbols.append(symbols.select("id", "kind", "name", "file_path", F.col("ord").cast("long").alias("ord")))
        return self

    def add_imports(self, links: DataFrame) -> Heritage:
        """``from_file``, ``to_file``."""
        self._imports.append(links.select("from_file", "to_file"))
        return self

    def add_files(self, files: DataFrame) -> Heritage:
        """``path``, ``content``, ``language``: their symbols, and what their classes extend."""
        found = cut(extract.symbols(files))
        self._clauses.append(clauses_of(found))
        return self.add_symbols(found)

    def edges(self) -> DataFrame:
        if not self._clauses:
            raise ValueError("no files have been added")
        every = lambda frames: functools.reduce(DataFrame.unionByName, frames) if frames else None
        return heritage.heritage_edges(every(self._clauses), every(self._symbols), every(self._imports))

    def linearisations(self, classes: DataFrame | None = None) -> DataFrame:
        """Of the classes asked for (``id``), else of all that extend something."""
        found = cut(self.edges())
        return heritage.linearisations(found, classes if classes is not None else found.where("kind = 'EXTENDS'").select(F.col("source_id").alias("id")).distinct())

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Classes and interfaces, and the edges between them."""
        found = cut(self.edges())
        return heritage.inheritance_nodes(functools.reduce(DataFrame.unionByName, self._symbols), found), found

    def stats(self) -> DataFrame:
        return heritage.heritage_stats(self.edges())


def analyse(graph: Graph, on_progress: Progress | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph with communities and processes written back; the memberships; the processes."""
    tell = on_progress or (lambda phase, done: None)
    weights = cut(community.call_weights(graph.nodes, graph.edges))
    members = cut(community.clusters(weights))
    names = community.labels(members, graph.nodes)
    tell("communities", 0.95)
    groups = names.select(F.concat(F.lit("Community:"), "component").alias("id"), F.lit("Community").alias("kind"), F.col("label").alias("name"))
    target = F.concat(F.lit("Community:"), F.col("component"))
    member_of = members.select(edge_id(F.col("node"), target, F.lit("MEMBER_OF")).alias("id"), F.col("node").alias("source_id"), target.alias("target_id"), F.lit("MEMBER_OF").alias("kind"), F.lit(1.0).alias("confidence"))
    belongs = members.select(F.col("node").alias("node_id"), F.col("component").alias("community_id"), F.lit(0).alias("ord"))
    flows = cut(process.processes(graph.nodes, graph.edges, belongs))
    flow_nodes, step_edges = process.write_back(flows)
    tell("processes", 1.0)
    out = graph.add_nodes(groups).add_nodes(flow_nodes).add_edges(member_of).add_edges(step_edges)
    return out, members, flows


def report(graph: Graph, members: DataFrame, flows: DataFrame, began: float) -> dict:
    """The counts of a run and how long it took."""
    files = graph.nodes.where("kind = 'File'").count()
    return {
        "files": files, "nodes": graph.nodes.count(), "edges": graph.edges.count(), "communities": members.select("component").distinct().count(),
        "processes": flows.count(), "seconds": round(time.time() - began, 3),
    }
