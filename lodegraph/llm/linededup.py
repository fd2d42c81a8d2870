"""Cross-site line deduplication by distinct-site spread. DataFrame functions only.

A HyperLogLog sketch of the sites that show a line is kept for each line's hash; partial sketches merge in the
aggregation, so a line on a third of all rows costs one sketch a task. Lines whose estimate is near the threshold get an
exact distinct count. Of a line on at least ``min_sites`` sites the first occurrence (smallest document id, then
position) stays and every other is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: Sketch size (a power of two): standard error 1.6 %.
LG_K = 12


#: A character that is not white space; spelled out, as engines differ in what their shorthands mean.
VISIBLE = r"[^\x09-\x0D\x{85}\p{Z}]"


def eligible(line: Column, min_words: int | None = None) -> Column:
    """Lines that are not blank; with ``min_words`` only those that have as many words as spaces part."""
    if min_words is None:
        return F.regexp_like(line, F.lit(VISIBLE))
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= min_words - 1


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``lines`` has ``h``, ``site``, ``doc_id``, ``row``, ``pos``. Returns a row for each hash on at least
    ``min_sites`` sites: ``h``, its first occurrence ``first`` (doc_id, row, pos) and ``n``, how many lines have it. A
    null site is no site.

    The sketch decides alone only where its estimate is under half or over twice the threshold (and 2 off at least),
    many standard errors away.
    """
    first = F.min(F.struct("doc_id", "row", "pos")).alias("first")
    low, high = min(min_sites / 2, min_sites - 2), max(min_sites * 2, min_sites + 2)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first, F.count(F.lit(1)).alias("n"))
    sketched = sketched.withColumn("spread", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("spread") >= max(low, min(1.5, min_sites - 0.5)))
    sketched = materialize(sketched, "line-spread")
    near = sketched.where(F.col("spread") <= high).select("h", "n")
    exact = join_counted(lines, near, "h", "n", "left_semi").where("site is not null").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    far = sketched.where(F.col("spread") > high).select("h", "first", "n")
    kept = sketched.join(exact.where(F.col("sites") >= min_sites).select("h"), "h", "left_semi").where(F.col("spread") <= high)
    return far.unionByName(kept.select("h", "first", "n"))


def without(parts: Column, gone: Column) -> Column:
    """The array without the places that ``gone`` (sorted, distinct, from 0) names, in one walk over both: between two
    places that go, all are taken."""

    def runs(lines: Column) -> Column:
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        edges = F.transform(F.concat(gone, F.array(F.size(lines))), lambda end, i: F.struct(begin(i).alias("begin"), end.alias("end")))
        full = F.filter(edges, lambda e: e["begin"] < e["end"])
        return F.flatten(F.transform(full, lambda e: F.transform(F.sequence(e["begin"], e["end"] - 1), lambda at: F.get(lines, at))))

    # the array is bound as a variable, so that it is made once and not for each element
    return F.transform(F.array(parts), runs)[0]


def dedup_lines(
    df: DataFrame,
    min_sites: int = 3,
    min_words: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``df`` with the text cleaned and two more columns, named by ``counts``: the lines of the text, and how many went.

    Lines end at each newline and are compared whole, by a 64-bit hash. Every line that is not blank counts. A null text
    stays null with 0 lines. A null id sorts first. Rows alike in id, site and text are one row for the purpose: if they
    hold a first occurrence, all of them keep it. A null site counts for no spread. Further columns pass through,
    whatever their names; only those that ``counts`` names are replaced. Texts are shuffled once, to meet the places of
    their removed lines, unless these are few enough to be broadcast. Time grows with a text's length, however many of
    its lines go.
    """
    given = [c for c in df.columns if c not in counts]
    text, doc_id, site = (F.col(f"`{c}`") for c in (text_column, id_column, site_column))
    row = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0")), F.coalesce(site.cast("string"), F.lit("\0")), F.coalesce(text, F.lit("\0")))
    # the caller's columns travel as one, so that none can clash with those made here
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in given if c != text_column]).alias("given"), doc_id.alias("doc_id"), site.cast("string").alias("site"), text.alias("text"), row.alias("row"))
    lines = docs.select("doc_id", "row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(eligible(F.col("line"), min_words)).select("doc_id", "row", "site", "pos", F.xxhash64("line").alias("h"))
    lines = materialize(lines, "lines")
    flagged = materialize(spread_lines(lines, min_sites), "lines-flagged")
    again = join_counted(lines, flagged, "h", "n").where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first")))
    removed = again.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    docs = docs.select("given", "text", "row").join(removed, "row", "left")
    none = F.col("gone").isNull()
    cleaned = F.when(none, F.col("text")).otherwise(F.array_join(without(F.split("text", "\n"), F.col("gone")), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.when(none, 0).otherwise(F.size("gone")).cast("long")
    columns = [cleaned.alias(c) if c == text_column else F.col(f"given.`{c}`") for c in given]
    return docs.select(*columns, n_lines.alias(counts[0]), n_removed.alias(counts[1]))
