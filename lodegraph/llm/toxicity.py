"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 5 lower-cased characters, hashed to 2**20 places. For each place the
training texts of either class that have it give the ratio r = log(P(place | toxic) / P(place | clean)). Every place whose
counts tell the classes apart (by the likelihood-ratio statistic) becomes a feature with the value r, and a logistic
regression with an L2 penalty is fitted on them. Scoring looks up every n-gram of the whole text, a window of it at a time.

Training reads at most ``max_training`` labelled documents, drawn by a hash of their ids: that bound is the only one.
Counting and extracting features run on the executors; the driver gets counts of places (at most 2**20 rows) and the
features of the drawn documents, packed, and fits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, lean_memory, materialize

SIZES = (3, 4, 5)
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS


#: Characters of a text whose n-grams are hashed at once.
WINDOW = 1 << 17


def lowered(text: str) -> str:
    """Lower case, each character by itself (a capital sigma is the same wherever it stands)."""
    return text.replace("\u03a3", "\u03c3").lower()


def places(text: str) -> Iterator[np.ndarray]:
    """The hashed places of all n-grams of the lowered text between two spaces, size by size and window by window; where
    windows meet, some come twice."""
    last = max(SIZES) - 1
    for lo in range(0, max(1, len(text)), WINDOW):
        part = lowered(text[lo : lo + WINDOW + last])
        part = f"{' ' if not lo else ''}{part}{' ' if lo + WINDOW + last >= len(text) else ''}"
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        rolled = codes
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in SIZES:
                yield ((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACE_BITS)).astype(np.int32)


def distinct_places(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The places that the text has, only those that ``wanted`` marks if given, in order."""
    found, held = [], 0
    for p in places(text):
        found.append(p if wanted is None else p[wanted[p]])
        held += len(found[-1])
        if held > 8 * WINDOW:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """``weights`` by place (0 where it is no feature), ``bias``, and the log-count ratios they were fitted with."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        margin = self.bias + self.weights[distinct_places(text, self.wanted)].sum(dtype=np.float64)
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))

    @property
    def wanted(self) -> np.ndarray:
        if not hasattr(self, "_wanted"):
            self._wanted = self.weights != 0
        return self._wanted


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, alpha: float = 1.0) -> np.ndarray:
    return np.log((toxic + alpha) / (n_toxic + 2 * alpha)) - np.log((clean + alpha) / (n_clean + 2 * alpha))


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Twice the log likelihood that class and place go together over that they do not."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    n, have = n_toxic + n_clean, toxic + clean
    rows = ((toxic, have * n_toxic / n), (clean, have * n_clean / n), (n_toxic - toxic, (n - have) * n_toxic / n), (n_clean - clean, (n - have) * n_clean / n))
    return 2 * sum(part(seen, expected) for seen, expected in rows)


def fit_logistic(lengths: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 100, at_once: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression (the bias is free), by L-BFGS over all rows. Row after row
    has ``lengths`` of the entries of ``column``; a column's entries all have its ``value``. Entries are gone through in
    blocks of whole rows, so that little is held beside them."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    cuts = [0]
    while cuts[-1] < len(lengths):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + at_once, "right")) - 1))
    blocks = [(a, b, column[ends[a] : ends[b]]) for a, b in itertools.pairwise(cuts)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its slope."""
        scaled, slope, loss = w[:-1] * value, np.zeros(len(w)), 0.5 * penalty * float(w[:-1] @ w[:-1])
        for a, b, mine in blocks:
            some = np.flatnonzero(lengths[a:b])
            margin = np.full(b - a, w[-1])
            if len(some):
                margin[some] += np.add.reduceat(scaled[mine], ends[a:b][some] - ends[a])
            loss += float((np.logaddexp(0, margin) - y[a:b] * margin).sum())
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[a:b]
            slope[:-1] += np.bincount(mine, np.repeat(error, lengths[a:b]), len(value))
            slope[-1] += error.sum()
        slope[:-1] = slope[:-1] * value + penalty * w[:-1]
        return loss, slope

    w = np.zeros(len(value) + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    loss, slope = at(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-4 * max(1.0, len(y) / 1000):
            break
        way, parts = -slope, []
        for moved, turned, scale in reversed(steps):
            parts.append(scale * float(moved @ way))
            way = way - parts[-1] * turned
        way = way / max(1.0, np.abs(slope).max()) if not steps else way * float(steps[-1][0] @ steps[-1][1]) / float(steps[-1][1] @ steps[-1][1])
        for (moved, turned, scale), part in zip(steps, reversed(parts)):
            way = way + (part - scale * float(turned @ way)) * moved
        size = 1.0
        while (new := at(w + size * way))[0] > loss + 1e-4 * size * float(slope @ way) and size > 1e-8:
            size /= 2
        moved, turned = size * way, new[1] - slope
        w, (loss, slope) = w + moved, new
        if float(moved @ turned) > 1e-12:
            steps = [*steps[-9:], (moved, turned, 1 / float(moved @ turned))]
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_training: int = 20_000, least_ratio: float = 20.0, penalty: float = 0.3, seed: int = 3) -> Model:
    """``labels`` has ``doc_id`` and ``toxic`` and holds only rows that may be learned from. Of repeated labels of a
    document the greatest counts, null ones are ignored, and whatever is above 0 says toxic; of documents that share an
    id the least text does, and a null text is empty. Without examples of both classes the model knows only how often a
    text is toxic. ``max_training`` and ``least_ratio`` (the least likelihood-ratio statistic of a feature) are all that
    limits what is learned.
    """
    drawn = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_training)
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    kept = materialize(kept.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxicity-training")
    n_toxic, n_all = kept.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        return Model(np.zeros(PLACES, np.float32), float(np.log((n_toxic + 1) / (n_clean + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        seen = np.zeros((2, PLACES), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[y, distinct_places(text.as_py())] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(at), 100_000):
            mine = at[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"place": mine.astype(np.int32), "clean": seen[0, mine], "toxic": seen[1, mine]})

    counts = kept.select("y", "text").mapInArrow(count, "place int, clean int, toxic int").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.where("clean + toxic >= 3").toPandas().sort_values("place")
    at, clean, toxic = (table[c].to_numpy() for c in ("place", "clean", "toxic"))
    told = likelihood_ratio(toxic, clean, n_toxic, n_clean)
    best = np.flatnonzero(told >= least_ratio)
    ratio = log_count_ratios(toxic[best], clean[best], n_toxic, n_clean)
    narrow = np.uint16 if len(best) <= 1 << 16 else np.int32
    column_of = np.full(PLACES, -1, np.int32)
    column_of[at[best]] = np.arange(len(best))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [column_of[distinct_places(t.as_py(), column_of >= 0)] for t in batch.column(1)]
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            columns = np.concatenate([*found, np.zeros(0, np.int32)]).astype(narrow)
            y = batch.column(0).to_numpy().astype(np.int8)
            yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in (("y", y), ("lengths", lengths), ("columns", columns))})

    packs = kept.select("y", "text").mapInArrow(extract, "y binary, lengths binary, columns binary").collect()
    y, lengths, column = (np.frombuffer(b"".join(bytes(p[i]) for p in packs), kind) for i, kind in enumerate((np.int8, np.int32, narrow)))
    del packs, table
    weights, bias = fit_logistic(lengths, column, ratio, y.astype(float), penalty)
    by_place = np.zeros(PLACES, np.float32)
    by_place[at[best]] = weights * ratio
    return Model(by_place, bias)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, a row a document, whole texts however long; a null text is empty, null ids stay. Nothing
    is shuffled. The model, 4 MB whatever was learned, is broadcast."""
    kind = docs.schema[id_column].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        own = Model(*held.value)
        for batch in batches:
            made = np.fromiter((own.score(t.as_py() or "") for t in batch.column(1)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, score double")


def filter_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold, each as often as it is there; a null text is
    empty, other columns may be null."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        own = Model(*held.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document: ``doc_id``, ``held_out`` (crc32 of the
    id as text, mod 3, is 1; never for a null id, whose text is empty), ``score`` (0 to 1) and ``predicted`` (1 from the
    threshold). Repeated rows stay; an empty table gives no rows; further columns are ignored."""
    learned = labels.where(id_crc() % 3 != 1)
    scored = score(docs, train(docs, learned, **parameters))
    return scored.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
