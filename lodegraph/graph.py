"""The graph: two DataFrames, immutable, with filters, neighbourhoods, changes and differences (F, J and A operators)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .operators import iterate


def conform(df: DataFrame, to) -> DataFrame:
    """The schema's columns in its order, missing ones null; a missing ``ord`` ranks by id."""
    have = set(df.columns)
    columns = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in to]
    return df.select(*columns)


@dataclass(frozen=True)
class Graph:
    """``nodes`` and ``edges``. Where "the first" counts, it is that of least ``ord``, then id."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, validate: bool = False) -> Graph:
        """First row of an id wins; ``validate`` drops edges without both of their ends."""
        order = F.struct(F.coalesce("ord", F.lit(2**62)), "id")
        made = cls(iterate.first_by(conform(nodes, schema.NODES).drop("metadata"), ["id"], order), iterate.first_by(conform(edges, schema.EDGES), ["id"], order))
        return made.without_dangling() if validate else made

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))

    # --- filters ---

    def find_nodes(self, kind=None, file_path: str | None = None, name: str | None = None, is_exported: bool | None = None, language: str | None = None) -> DataFrame:
        """every given criterion holds. ``file_path`` and ``name`` are patterns found anywhere; null is not false."""
        return self.nodes.where(node_filter(kind, file_path, name, is_exported, language))

    def find_edges(self, kind=None, source_id: str | None = None, target_id: str | None = None, min_confidence: float | None = None) -> DataFrame:
        """F2."""
        return self.edges.where(edge_filter(kind, source_id, target_id, min_confidence))

    def node(self, node_id: str) -> DataFrame:
        """F5."""
        return self.nodes.where(F.col("id") == node_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id)

    # --- neighbourhoods ---

    def outgoing(self, node_id: str) -> DataFrame:
        """J1."""
        return self.edges.where(F.col("source_id") == node_id)

    def incoming(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("target_id") == node_id)

    def neighbors(self, of: DataFrame) -> DataFrame:
        """For each ``root`` of ``of`` the nodes at the other ends, once for each edge; ends that are no node go."""
        pairs = iterate.steps(self.edges, "both")
        return of.select(F.col("root").alias("src")).join(pairs, "src").join(self.nodes.withColumnRenamed("id", "dst"), "dst").withColumnsRenamed({"src": "root", "dst": "id"})

    def related(self, of: DataFrame, kind: str | None = None) -> DataFrame:
        """The distinct neighbours, over edges of one kind if given."""
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        found = of.select(F.col("root").alias("src")).join(iterate.steps(edges, "both"), "src").where("src <> dst").distinct()
        return found.join(self.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("id"))

    # --- changes ---

    def add_nodes(self, new: DataFrame) -> Graph:
        """Rows whose id is there already change nothing."""
        fresh = new.join(self.nodes.select("id"), "id", "left_anti")
        return Graph(self.nodes.unionByName(fresh, allowMissingColumns=True), self.edges)

    def add_edges(self, new: DataFrame, validate: bool = False) -> Graph:
        fresh = new.join(self.edges.select("id"), "id", "left_anti")
        made = Graph(self.nodes, self.edges.unionByName(fresh, allowMissingColumns=True))
        return made.without_dangling() if validate else made

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """The nodes with the ids of ``gone``, and the edges at them."""
        ids = gone.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return Graph(self.nodes.join(ids, "id", "left_anti"), edges.select(self.edges.columns))

    def remove_edges(self, gone: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(gone.select("id").distinct(), "id", "left_anti"))

    def update_nodes(self, changed: DataFrame) -> Graph:
        """Replace or add."""
        return Graph(self.nodes.join(changed.select("id"), "id", "left_anti").unionByName(changed, allowMissingColumns=True), self.edges)

    def dangling(self) -> DataFrame:
        """Edges of which an end is no node."""
        whole = self.without_dangling().edges.select("id")
        return self.edges.join(whole, "id", "left_anti")

    def without_dangling(self) -> Graph:
        ids = self.nodes.select("id")
        kept = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return Graph(self.nodes, kept.select(self.edges.columns))

    def diff(self, previous: Graph) -> DataFrame:
        """``change``, ``entity`` and ``id`` of what was added and removed, by id."""
        sides = []
        for entity, now, before in (("node", self.nodes, previous.nodes), ("edge", self.edges, previous.edges)):
            for change, a, b in (("added", now, before), ("removed", before, now)):
                sides.append(a.select("id").join(b.select("id"), "id", "left_anti").select(F.lit(change).alias("change"), F.lit(entity).alias("entity"), "id"))
        out = sides[0]
        for more in sides[1:]:
            out = out.unionByName(more)
        return out

    def apply(self, added_nodes=None, removed_nodes=None, updated_nodes=None, added_edges=None, removed_edges=None, updated_edges=None) -> Graph:
        """In this order - add nodes, remove nodes with their edges, update nodes, add edges, remove edges, update edges.
        What is missing is empty."""
        made = self
        if added_nodes is not None:
            made = made.add_nodes(added_nodes)
        if removed_nodes is not None:
            made = made.remove_nodes(removed_nodes)
        if updated_nodes is not None:
            made = made.update_nodes(updated_nodes)
        if added_edges is not None:
            made = made.add_edges(added_edges)
        if removed_edges is not None:
            made = made.remove_edges(removed_edges)
        if updated_edges is not None:
            rest = made.edges.join(updated_edges.select("id"), "id", "left_anti")
            made = Graph(made.nodes, rest.unionByName(updated_edges, allowMissingColumns=True))
        return made

    # --- aggregates ---

    def metadata(self) -> DataFrame:
        """K1: one row with the counts, the languages, and the histograms of kinds, as maps."""
        kinds = self.nodes.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("node_kinds"), F.sum("count").alias("node_count"))
        relations = self.edges.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("relation_kinds"), F.sum("count").alias("edge_count"))
        languages = self.nodes.agg(F.array_sort(F.collect_set("language")).alias("languages"))
        joined = kinds.join(relations, F.lit(True)).join(languages, F.lit(True))
        return joined.select(F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "languages", "node_kinds", "relation_kinds")

    def degrees(self) -> DataFrame:
        """``id``, ``fan_out`` and ``fan_in``, edges counted as often as they are; nodes without edges have none."""
        return fan(self.nodes.select("id"), self.edges)


def node_filter(kind=None, file_path=None, name=None, is_exported=None, language=None) -> Column:
    out = F.lit(True)
    if kind:
        out &= F.col("kind").isin([kind] if isinstance(kind, str) else list(kind))
    if file_path:
        out &= F.col("file_path").rlike(file_path)
    if name:
        out &= F.col("name").rlike(name)
    if is_exported is not None:
        out &= F.col("is_exported").eqNullSafe(F.lit(is_exported))
    if language:
        out &= F.col("language") == language
    return out


def edge_filter(kind=None, source_id=None, target_id=None, min_confidence=None) -> Column:
    out = F.lit(True)
    if kind:
        out &= F.col("kind").isin([kind] if isinstance(kind, str) else list(kind))
    if source_id:
        out &= F.col("source_id") == source_id
    if target_id:
        out &= F.col("target_id") == target_id
    if min_confidence is not None:
        out &= F.col("confidence") >= min_confidence
    return out


def fan(ids: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("id").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    return ids.join(counted, "id", "left").select("id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


class NodeQuery:
    """a fluent filter; the last call of a kind wins. Nothing runs before the DataFrame does."""

    def __init__(self, graph: Graph):
        self.graph, self.nodes_by, self.edges_by = graph, {}, {}

    def where_kind(self, *kinds: str) -> NodeQuery:
        self.nodes_by["kind"] = list(kinds)
        return self

    def where_file(self, pattern: str) -> NodeQuery:
        self.nodes_by["file_path"] = pattern
        return self

    def where_name(self, pattern: str) -> NodeQuery:
        self.nodes_by["name"] = pattern
        return self

    def where_exported(self, exported: bool = True) -> NodeQuery:
        self.nodes_by["is_exported"] = exported
        return self

    def where_language(self, language: str) -> NodeQuery:
        self.nodes_by["language"] = language
        return self

    def with_relation(self, *kinds: str) -> NodeQuery:
        self.edges_by["kind"] = list(kinds)
        return self

    def with_confidence(self, least: float) -> NodeQuery:
        self.edges_by["min_confidence"] = least
        return self

    def find_nodes(self) -> DataFrame:
        return self.graph.find_nodes(**self.nodes_by)

    def find_edges(self) -> DataFrame:
        return self.graph.find_edges(**self.edges_by)

    def find_connected(self, start: str, depth: int = 1) -> DataFrame:
        """Nodes at most ``depth - 1`` undirected hops away, the start included."""
        spark = self.graph.nodes.sparkSession
        root = spark.createDataFrame([(start,)], "root string")
        found = iterate.reach(iterate.steps(self.graph.find_edges(**self.edges_by), "both"), root, max(0, depth - 1))
        return self.graph.find_nodes(**self.nodes_by).join(found.select(F.col("node").alias("id"), "depth"), "id")


def search(nodes: DataFrame, name: str | None = None, exact: bool = False, kind: str | None = None, file: str | None = None, pattern: bool = False, language: str | None = None, exported: bool | None = None) -> DataFrame:
    """Nodes that meet all criteria, none without any. Names match whole or as part, case aside; files as part or
    by pattern; a node not known to be exported counts as not exported."""
    tests = []
    if name is not None:
        tests.append(F.col("name") == name if exact else F.lower("name").contains(name.lower()))
    if kind is not None:
        tests.append(F.col("kind") == kind)
    if file is not None:
        tests.append(F.col("file_path").rlike(file) if pattern else F.col("file_path").contains(file))
    if language is not None:
        tests.append(F.col("language") == language)
    if exported is not None:
        tests.append(F.coalesce("is_exported", F.lit(False)) == exported)
    out = F.lit(bool(tests))
    for test in tests:
        out &= test
    return nodes.where(out)


def top_matches(nodes: DataFrame, query: str, kind: str | None = None, file: str | None = None, limit: int = 20) -> DataFrame:
    """the first nodes, by order, whose name or path holds the query, case aside."""
    wanted = query.lower()
    test = F.lower("name").contains(wanted) | F.lower("file_path").contains(wanted)
    if kind:
        test &= F.col("kind") == kind
    if file:
        test &= F.col("file_path").contains(file)
    return nodes.where(test).orderBy("ord", "id").limit(limit).select("id", "kind", "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("is_exported").alias("exported"))


def resolve_symbols(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (column ``symbol``) with ``id``: the symbol itself if it has a colon and is a node, else the first
    node of that name, else null."""
    by_id = asked.where(F.col("symbol").contains(":")).join(nodes.select("id"), F.col("symbol") == F.col("id"), "left").select("symbol", "id")
    first = nodes.groupBy(F.col("name").alias("symbol")).agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    by_name = asked.where(~F.col("symbol").contains(":")).join(first, "symbol", "left").select("symbol", "id")
    return by_id.unionByName(by_name)


def inverted_index(nodes: DataFrame, column: str) -> DataFrame:
    """A4: ids by the values of a column, in order."""
    entries = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return nodes.groupBy(column).agg(F.transform(entries, lambda e: e["id"]).alias("ids"))


def keep_newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
