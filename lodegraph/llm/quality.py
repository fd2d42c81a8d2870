"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each, and
the posterior probability that a text is good replaces a filter that wants every rule to pass.

One pass over the texts measures them and notes each rule's vote. Documents with the same votes are alike to the model,
so it is fitted on how often each pattern of votes occurs among those that the base rule lets pass: with ten rules of three outcomes at most 59,049 rows,
whatever the corpus, counted over all documents. They are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8_texts

SYMBOLS, SPACES, DIGITS, ENDS = b"#*$%&|<>", b" \t\n\v\f\r", b"0123456789", b".!?"
UPPER = bytes(range(65, 91))
LETTERS = np.zeros(256, bool)
LETTERS[list(UPPER) + list(range(97, 123)) + list(range(0xC0, 256))] = True  # a lead byte stands for its character
CONTINUED = np.zeros(256, bool)
CONTINUED[0x80:0xC0] = True
IS_SPACE, IS_END = np.zeros(256, bool), np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
IS_END[list(ENDS)] = True

#: What a rule measures, the range in which it votes good, and the range outside which it votes bad; between them it
#: abstains. All are shares but for the mean word length in characters.
RULES = {
    "symbols_per_word": (0.0, 0.02, 0.0, 0.1),
    "mean_word_length": (4.0, 7.0, 3.0, 10.0),
    "duplicate_lines": (0.0, 0.1, 0.0, 0.3),
    "repeated_words": (0.0, 0.08, 0.0, 0.25),
    "distinct_words": (0.5, 1.0, 0.3, 1.0),
    "sentence_ends": (0.04, 0.35, 0.015, 0.6),
    "letters": (0.75, 1.0, 0.68, 1.0),
    "commonest_word": (0.0, 0.15, 0.0, 0.3),
    "capitals": (0.0, 0.1, 0.0, 0.3),
    "digits": (0.0, 0.08, 0.0, 0.25),
}
FIXED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """How many words lie in a window that occurs twice or more in the text."""
    if len(ids) < window:
        return 0
    code, base = ids[: len(ids) - window + 1], distinct
    for i in range(1, window):
        if base > 1 << 40:  # before the product could overflow
            code = np.unique(code, return_inverse=True)[1]
            base = int(code.max()) + 1
        code = code * distinct + ids[i : len(ids) - window + 1 + i]
        base *= distinct
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(window):
        covered[i : len(again) + i] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The five base figures, and the rules' measures (none without words)."""
    words = text.split()  # on bytes: at the six ASCII white-space characters
    if not words:
        return (0, 0, _count(np.bincount(np.frombuffer(text, np.uint8), minlength=256), SYMBOLS), 0, 0), []
    data = np.frombuffer(text, np.uint8)
    seen = np.bincount(data, minlength=256)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(words)
    chars = int(len(text) - seen[CONTINUED].sum() - _count(seen, SPACES))
    symbols = _count(seen, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = len(lines) - len(set(lines))
    repeats = repeated_words(ids, len(known))
    ends = IS_END[data]
    finished = np.count_nonzero(ends[:-1] & IS_SPACE[data[1:]]) + int(ends[-1])
    measures = [
        symbols / n, chars / n, again / max(1, len(lines)), repeats / n, len(known) / n, finished / n,
        seen[LETTERS].sum() / chars, np.bincount(ids).max() / n, _count(seen, UPPER) / chars, _count(seen, DIGITS) / chars,
    ]
    return (n, chars, symbols, again, repeats), measures


def _count(seen: np.ndarray, characters: bytes) -> int:
    return int(sum(seen[c] for c in characters))


def votes(measures: list[float]) -> int:
    """The rules' outcomes (0 abstains, 1 bad, 2 good) as one number in base 3; all abstain without words."""
    pattern = 0
    for value, (good_low, good_high, low, high) in zip(measures or (), RULES.values()):
        outcome = 2 if good_low <= value <= good_high else 1 if not low <= value <= high else 0
        pattern = pattern * 3 + outcome
    return pattern


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Outcomes, a row a pattern and a column a rule."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return patterns[:, None] // powers % 3


@dataclass
class LabelModel:
    """``good[j]`` is how often rule j, when it votes on a good text, is right, and ``bad[j]`` the same for bad texts."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def log_odds(self, outcomes: np.ndarray) -> np.ndarray:
        for_good, for_bad = outcomes == 2, outcomes == 1
        told = for_good * (np.log(self.good) - np.log1p(-self.bad)) + for_bad * (np.log1p(-self.good) - np.log(self.bad))
        return np.log(self.prior / (1 - self.prior)) + told.sum(axis=1)

    def posterior(self, outcomes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(outcomes), -700, 700)))


def fit(outcomes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> LabelModel:
    """Expectation-maximisation over patterns and their counts.

    ``strength`` imagined votes stand behind each rule: right 9 times in 10 on good texts, and 4 times in 10 on bad ones,
    since a rule knows one fault and bad texts mostly have another. On good texts no accuracy falls below 0.6, so that
    the classes cannot change places.
    """
    prior, on_good, on_bad = 0.8, 0.9, 0.4
    n = outcomes.shape[1]
    model = LabelModel(prior, np.full(n, on_good), np.full(n, on_bad))
    for _ in range(rounds):
        is_good = model.posterior(outcomes)
        w_good, w_bad = counts * is_good, counts * (1 - is_good)
        right = lambda w, outcome, centre: ((w @ (outcomes == outcome)) + centre * strength) / ((w @ (outcomes > 0)) + strength)
        share = (w_good.sum() + prior * strength) / (counts.sum() + strength)
        model = LabelModel(share, np.clip(right(w_good, 2, on_good), 0.6, 0.9999), np.clip(right(w_bad, 1, on_bad), 0.02, 0.9999))
    return model


def judge(df: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a document: ``doc_id``, the five base figures, ``base_failed``, ``posterior`` (that it is good) and ``kept``
    (not base_failed, and posterior at least the threshold).

    A null text is empty. Texts without words fail the base. Rows are judged one by one from what all of them taught, so
    repeated rows teach as often as they occur; null ids and further columns change nothing; an empty table gives no rows.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in FIXED) + ", pattern bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*figures, votes(measures)) for figures, measures in map(measure, utf8_texts(batch.column(1)))]
            columns = np.array(made, np.int64).reshape(-1, len(FIXED) + 1).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *FIXED, "pattern"])

    measured = materialize(df.select(id_column, text_column).mapInArrow(run, schema), "quality")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    table = measured.groupBy("pattern").agg(F.count(F.when(~failed, 1)).alias("count")).toPandas().sort_values("pattern")
    outcomes = unpacked(table["pattern"].to_numpy(np.int64))
    posterior = fit(outcomes, table["count"].to_numpy(float)).posterior(outcomes)
    spark = df.sparkSession
    told = spark.createDataFrame(list(zip(map(int, table["pattern"]), map(float, posterior))), "pattern bigint, posterior double")
    out = measured.join(F.broadcast(told), "pattern").withColumn("base_failed", failed)
    return out.select("doc_id", *FIXED, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
