"""What a command line offers, as functions: analyze, status, list, clean, and the answers of a server (Q8, Q9).

``home`` is a folder, on any file system, that holds the registry and an index for each repository.
"""

from __future__ import annotations

import hashlib
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import community
from .plans import ingest
from .sources import store, walk
from .tools import Engine

NAME = "lodegraph"
#: What a server answers to.
ENDPOINTS = ("/health", "/api/stats", "/api/status")


def registry(home: str) -> str:
    return f"{home.rstrip('/')}/registry"


def current_version(spark: SparkSession, root: str) -> str | None:
    """The commit that a repository is at, as its files say; None if it has none."""

    def read(name: str) -> str | None:
        return walk.read_text(spark, f"{root.rstrip('/')}/.git/{name}")

    head = (read("HEAD") or "").strip()
    if not head.startswith("ref: "):
        return head or None
    if found := read(head[5:]):
        return found.strip()
    packed = (line.split(" ", 1) for line in (read("packed-refs") or "").splitlines() if line.endswith(" " + head[5:]))
    return next((commit for commit, _ in packed), None)


def analyze(spark: SparkSession, root: str, home: str, force: bool = False, options: walk.WalkOptions | None = None, skills: bool = False) -> dict:
    """Index a repository, unless it is at the version that is indexed and ``force`` is not set. Returns its entry in the
    registry with ``fresh``, whether it has been indexed now. ``skills`` also writes the report on its areas and flows."""
    root = root.rstrip("/")
    version, known = current_version(spark, root), entry(spark, root, home)
    if known and version and version == known["version"] and not force:
        return known | {"fresh": False}
    began = time.time()
    graph, members, flows = ingest.analyse(ingest.build(walk.walk(spark, root, options)))
    index = f"{home.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:16]}"
    store.save(graph, index)
    if skills:
        labels = community.labels(members, graph.nodes)
        store.skills_report(members, labels, flows).write.mode("overwrite").parquet(f"{index}/skills")
    made = {"path": root, "name": root.rsplit("/", 1)[-1], "index": index, "version": version, "indexed_at": datetime.now(timezone.utc).isoformat(), "stats": ingest.report(graph, members, flows, began)}
    store.write_registry(spark, registry(home), [made])
    return made | {"fresh": True}


def entry(spark: SparkSession, root: str, home: str) -> dict | None:
    return next((e for e in store.read_registry(spark, registry(home)) if e["path"] == root.rstrip("/")), None)


def status(spark: SparkSession, root: str, home: str) -> dict | None:
    """The entry of a repository with its ``current_version`` and whether it is ``up_to_date``; None if it is not indexed."""
    known = entry(spark, root, home)
    if known is None:
        return None
    now = current_version(spark, root)
    return known | {"current_version": now, "up_to_date": now is not None and now == known["version"]}


def list_repositories(spark: SparkSession, home: str) -> DataFrame:
    """``name``, ``path``, ``indexed_at`` and the counts of each indexed repository."""
    counts = ("files", "nodes", "edges", "communities", "processes")
    rows = [(e["name"], e["path"], e["indexed_at"], *(e["stats"][c] for c in counts)) for e in store.read_registry(spark, registry(home))]
    return spark.createDataFrame(rows, "name string, path string, indexed_at string, " + ", ".join(f"{c} bigint" for c in counts)).orderBy(F.col("name"), F.col("path"))


def clean(spark: SparkSession, home: str, root: str | None = None) -> list[str]:
    """Delete the index of one repository, or of all; returns the folders that are gone."""
    return store.clean(spark, registry(home), root.rstrip("/") if root else None)


def open_index(spark: SparkSession, root: str, home: str) -> Engine:
    """The tools over what is indexed."""
    known = entry(spark, root, home)
    if known is None:
        raise KeyError(f"not indexed: {root}")
    return Engine(store.load(spark, known["index"]), known["name"])


def respond(spark: SparkSession, root: str, home: str, path: str) -> tuple[int, dict]:
    """Q9: what a server answers to a path: a status code and a body."""
    if path == "/health":
        return 200, {"status": "healthy", "version": store.VERSION, "timestamp": datetime.now(timezone.utc).isoformat()}
    if path == "/api/status":
        return 200, {"name": NAME, "version": store.VERSION, "repo": root, "endpoints": list(ENDPOINTS)}
    if path == "/api/stats":
        known = entry(spark, root, home)
        return (200, known["stats"]) if known else (500, {"error": "Failed to read stats"})
    return 404, {"error": "Not found"}
