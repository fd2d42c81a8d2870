"""Saving and loading graphs, backups, the registry, and reports."""

from __future__ import annotations

import json
import time
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph

VERSION = "1.0.0"
MAX_BACKUPS = 5


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def save(graph: Graph, path: str) -> None:
    """K2: two Parquet tables, and the metadata as one line of JSON."""
    graph.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    told = graph.metadata().withColumn("version", F.lit(VERSION)).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    told.write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Graph:
    nodes, edges = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("nodes", schema.NODES), ("edges", schema.EDGES)))
    found = spark.read.json(f"{path}/metadata").select("version").first()
    if found is None or found[0] != VERSION:
        warnings.warn(f"saved by version {found and found[0]}, read by {VERSION}", stacklevel=2)
    return Graph(nodes, edges)


def load_or_empty(spark: SparkSession, path: str) -> Graph:
    """S15."""
    system, where = _fs(spark, f"{path}/metadata")
    return load(spark, path) if system.exists(where) else Graph.empty(spark)


def save_json(graph: Graph, path: str) -> None:
    """One JSON object a line, each tagged with what it is: splittable, unlike one document."""
    nodes = graph.nodes.select(F.lit("node").alias("entity"), F.to_json(F.struct("*")).alias("body"))
    edges = graph.edges.select(F.lit("edge").alias("entity"), F.to_json(F.struct("*")).alias("body"))
    nodes.unionAll(edges).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> Graph:
    """Unreadable lines are dropped; the first row of an id wins."""
    rows = spark.read.schema("entity string, body string").json(path)
    nodes = rows.where("entity = 'node'").select(F.from_json("body", schema.NODES).alias("n")).select("n.*").where("id is not null")
    edges = rows.where("entity = 'edge'").select(F.from_json("body", schema.EDGES).alias("e")).select("e.*").where("id is not null")
    return Graph.of(nodes, edges)


def load_document(spark: SparkSession, path: str) -> Graph:
    """A single JSON document with ``nodes`` and ``edges`` in camel case, as other tools write it."""
    node = "id string, kind string, name string, filePath string, startLine int, endLine int, language string, isExported boolean, metadata map<string,string>"
    edge = "id string, sourceId string, targetId string, kind string, confidence double, reason string, step int"
    read = spark.read.schema(f"version string, nodes array<struct<{_typed(node)}>>, edges array<struct<{_typed(edge)}>>").option("multiLine", "true").json(path)
    names = {"filePath": "file_path", "startLine": "start_line", "endLine": "end_line", "isExported": "is_exported", "sourceId": "source_id", "targetId": "target_id"}
    nodes = read.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*").withColumnsRenamed(names)
    edges = read.select(F.posexplode("edges").alias("ord", "e")).select("ord", "e.*").withColumnsRenamed(names)
    return Graph.of(nodes, edges)


def _typed(columns: str) -> str:
    return ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in columns.split(", "))


def backup(graph: Graph, folder: str, name: str | None = None, keep: int = MAX_BACKUPS) -> str:
    """K4: save under ``folder`` and remove all but the newest ``keep``."""
    path = f"{folder}/{name or f'backup-{time.time_ns()}'}"
    save(graph, path)
    for old in [b["path"] for b in backups(graph.nodes.sparkSession, folder) if b["place"] > keep]:
        system, where = _fs(graph.nodes.sparkSession, old)
        system.delete(where, True)
    return path


def backups(spark: SparkSession, folder: str) -> list[dict]:
    """Newest first: ``path``, ``modified``, ``place`` from 1."""
    system, where = _fs(spark, folder)
    if not system.exists(where):
        return []
    found = [(s.getModificationTime(), s.getPath().toString()) for s in system.listStatus(where) if s.isDirectory()]
    return [{"path": p, "modified": m, "place": i} for i, (m, p) in enumerate(sorted(found, reverse=True), 1)]


def latest_backup(spark: SparkSession, folder: str) -> str | None:
    found = backups(spark, folder)
    return found[0]["path"] if found else None


def restore(spark: SparkSession, folder: str, name: str) -> Graph:
    return load(spark, f"{folder}/{name}")


def upsert_registry(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """K5: the registry with these entries in place of those of the same path."""
    return registry.join(entries.select("path"), "path", "left_anti").unionByName(entries, allowMissingColumns=True)


def write_registry(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """The registry file of repositories, a line of JSON each, rewritten whole; it is small."""
    known = {e["path"]: e for e in read_registry(spark, path)} | {e["path"]: e for e in entries}
    _put(spark, path, "".join(json.dumps(e, sort_keys=True) + "\n" for e in known.values()))


def read_registry(spark: SparkSession, path: str) -> list[dict]:
    system, where = _fs(spark, path)
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()] if system.exists(where) else []


def clean(spark: SparkSession, registry: str, repository: str | None = None) -> list[str]:
    """K7: delete the indexes of one repository or of all, and take them out of the registry. Returns what was deleted."""
    entries = read_registry(spark, registry)
    gone = [e for e in entries if repository is None or e["path"] == repository]
    for e in gone:
        system, where = _fs(spark, e["index"])
        system.delete(where, True)
    left = [e for e in entries if e not in gone]
    _put(spark, registry, "".join(json.dumps(e, sort_keys=True) + "\n" for e in left))
    return [e["index"] for e in gone]


def _put(spark: SparkSession, path: str, text: str) -> None:
    system, where = _fs(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def skills_report(members: DataFrame, labels: DataFrame, processes: DataFrame, top: int = 10, shown: int = 20) -> DataFrame:
    """K6: the largest communities with their first members, and the first processes with their steps, as lines of
    Markdown: ``place``, ``line``."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.join(labels, "component").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "component"))).where(F.col("rank") <= top)
    some = members.join(best, "component").withColumn("at", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("at") <= shown)
    heads = best.select((F.col("rank") * 1000).alias("place"), F.format_string("## %s (%d symbols)", "label", "n").alias("line"))
    items = some.select((F.col("rank") * 1000 + F.col("at")).alias("place"), F.concat(F.lit("- "), "node").alias("line"))
    flows = processes.where(F.col("idx") < top)
    titles = flows.select(((F.col("idx") + 1) * 1000 + 1_000_000).alias("place"), F.concat(F.lit("## "), "label").alias("line"))
    steps = flows.select("idx", F.posexplode("trace").alias("at", "node")).select(((F.col("idx") + 1) * 1000 + F.col("at") + 1_000_001).alias("place"), F.concat((F.col("at") + 1).cast("string"), F.lit(". "), "node").alias("line"))
    return heads.unionAll(items).unionAll(titles).unionAll(steps).select(F.col("place").cast("long").alias("place"), "line").orderBy("place")
