"""Ranking: BM25, vector and fused search, change impact, rename preview."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .traverse import impact

K1, B, RRF = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents (``doc``, ``text``) for each query (``query``, ``text``): ``query``, ``doc``, ``score``,
    ``rank``. Ties go to the smaller document.

    Only the queries' terms are carried through: postings are cut by a semi-join with them before they are counted.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = docs.select("doc", terms(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    corpus = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    postings = words.select("doc", "length", F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    postings = cut(postings.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = postings.join(frequency, "term").join(corpus, F.lit(True)).join(asked, "term")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = joined.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 512, at_once: int = 16) -> DataFrame:
    """The ``k`` nearest by cosine for each query vector: ``query``, ``doc``, ``score``, ``rank``; exact.

    Queries, in any number, are gone through in order: each pass over the vectors takes ``at_once`` blocks of ``block`` of
    them, which the driver holds and sends, and multiplies a block with each batch of vectors, of which only every batch's
    ``k`` best are passed on. Rankings of more than one pass are written as they come.
    """

    def one_pass(rows: list) -> DataFrame:
        names = np.array([r["query"] for r in rows], np.int64)
        wanted = np.array([r["vector"] for r in rows], np.float64)
        wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                if not len(frame):
                    continue
                held = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)
                ids = frame["doc"].to_numpy(np.int64)
                for lo in range(0, len(names), block):
                    score = np.round(wanted[lo : lo + block] @ held.T, 6)
                    best = [np.lexsort((ids, -row))[:k] for row in score]
                    yield pd.DataFrame({"query": np.repeat(names[lo : lo + block], list(map(len, best))), "doc": ids[np.concatenate(best)], "score": np.concatenate([row[b] for row, b in zip(score, best)])})

        return top(vectors.select("doc", "vector").mapInPandas(run, "query bigint, doc bigint, score double"), k)

    asked = cut(queries.select("query", "vector").orderBy("query")).orderBy("query").toLocalIterator()
    passes = iter(lambda: list(itertools.islice(asked, block * at_once)), [])
    first = next(passes, [])
    if not first:
        return top(vectors.select(F.lit(0).cast("bigint").alias("query"), F.col("doc").cast("bigint").alias("doc"), F.lit(0.0).alias("score")).limit(0), k)
    out = one_pass(first)
    for number, rows in enumerate(passes):
        out = (cut(out) if not number else out).unionByName(cut(one_pass(rows)))
    return out


def fuse(rankings: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rankings with ``query``, ``doc``, ``rank``."""
    every = rankings[0].select("query", "doc", "rank")
    for more in rankings[1:]:
        every = every.unionAll(more.select("query", "doc", "rank"))
    return top(every.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score")), k)


def by_process(hits: DataFrame, flows: DataFrame, k: int | None = None) -> DataFrame:
    """Hits (``query``, ``doc``, ``score``) under the processes that they are steps of: ``query``, ``process``, ``label``,
    ``process_type``, ``step_count``, ``process_score`` (the sum over its hits), ``process_rank``, ``doc``, ``step`` (the first, if
    it is several) and ``score``. A hit in several processes stands under each; those in none stand under a null process
    that is last. ``flows`` is what ``process.processes`` gives; ``k`` keeps the first processes of each query.
    """
    steps = flows.select(F.col("id").alias("process"), "label", "process_type", "step_count", F.posexplode("trace").alias("at", "doc"))
    steps = steps.groupBy("process", "doc").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("label", "process_type", "step_count")])
    placed = hits.select("query", "doc", "score").join(steps, "doc", "left")
    groups = placed.groupBy("query", "process").agg(F.round(F.sum("score"), 9).alias("process_score"))
    order = Window.partitionBy("query").orderBy(F.col("process").isNull(), F.desc("process_score"), "process")
    groups = groups.withColumn("process_rank", F.row_number().over(order))
    if k is not None:
        groups = groups.where(F.col("process_rank") <= k)
    named = groups.withColumnsRenamed({"query": "_query", "process": "_process"})
    joined = placed.join(named, (F.col("query") == F.col("_query")) & F.col("process").eqNullSafe(F.col("_process")))
    return joined.select("query", "process", "label", "process_type", "step_count", "process_score", "process_rank", "doc", (F.col("at") + 1).alias("step"), "score")


def changed_symbols(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols whose lines meet a changed range (``file_path``, ``first``, ``last``)."""
    spans = nodes.select("id", "file_path", "start_line", "end_line")
    return changes.join(spans, "file_path").where((F.col("start_line") <= F.col("last")) & (F.col("first") <= F.col("end_line"))).select("id").distinct()


def change_impact(changes: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """What calls the changed symbols, directly or not: ``node`` and its least ``depth``, the changed at 0."""
    changed = cut(changed_symbols(changes, nodes).withColumnRenamed("id", "root"))
    above = impact(nodes, edges, changed, "upstream", max_depth)
    every = changed.select(F.col("root").alias("node"), F.lit(0).alias("depth")).unionAll(above.select("node", "depth"))
    return every.groupBy("node").agg(F.min("depth").alias("depth"))


def rename_preview(nodes: DataFrame, edges: DataFrame, files: DataFrame, symbol: str) -> DataFrame:
    """For renaming a symbol (an id): ``file_path``, ``graph_edits`` (definitions and references by edges) and
    ``text_edits`` (whole-word occurrences of its name in the file's text)."""
    target = nodes.where(F.col("id") == symbol).select("id", "name", "file_path").limit(1)
    users = edges.join(target.select(F.col("id").alias("target_id")), "target_id").select(F.col("source_id").alias("id")).join(nodes.select("id", "file_path"), "id").select("file_path")
    graph = users.unionAll(target.select("file_path")).groupBy("file_path").agg(F.count(F.lit(1)).alias("graph_edits"))
    name = target.select("name")
    text = files.join(name, F.lit(True)).withColumn("text_edits", F.regexp_count("content", F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b")))).where("text_edits > 0").select(F.col("path").alias("file_path"), "text_edits")
    return graph.join(text, "file_path", "full").select("file_path", F.coalesce("graph_edits", F.lit(0)).alias("graph_edits"), F.coalesce("text_edits", F.lit(0)).alias("text_edits"))


def classify(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """``scores`` (array) for each ``text`` from a model that ``load`` makes once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            yield frame.assign(scores=model(frame["text"].tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", scores array<double>"
    return texts.mapInPandas(run, schema)
