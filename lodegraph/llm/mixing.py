"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

1. Every source gets a target: its weight's share of all tokens, at most ``max_repeats`` times what it has; what that
   cuts off is shared again by weight.
2. Blocks of ``block_tokens`` tokens are seats. They go to the sources by highest quotients target / (2k + 1), then
   within each source to its shards by highest quotients of their tokens.
3. A shard's documents, in an order drawn by seeded hashes, are one stream of tokens cut into blocks. A shard with q
   seats and n blocks takes each block q div n times and q mod n blocks, a run that begins at a seeded block and wraps
   around, once more.

The token counts, one small row a document, are written once. Shards hold at most about ``shard_tokens`` tokens until
there are ``max_shards`` in all, so a source with a third of the corpus has a third of the shards, and no window holds
a whole source. Tables of sources and shards are small: one row a source, at most ``max_shards`` more for the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hold, join_counted, materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """``sizes`` has a row a source with ``source`` and ``source_size``. Sources by code point, null last, take the
    weights in turn. Returns these columns, ``weight``, ``target`` and ``rank`` (from 0).

    A target is the least of max_repeats * source_size and level * weight, the level being such that targets add up to
    the tokens there are. In order of cap a weight, the sources that stay at their caps are a prefix, so one pass of
    running sums finds the level: no loop over rounds of resharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first source whose cap the level does not reach fixes the level for all that follow
    fixed = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = F.when(F.col("full") | fixed.isNull(), F.col("cap")).otherwise(F.least("cap", fixed * F.col("weight")))
    return found.withColumn("target", target.cast("double")).select("source", "source_size", "weight", "target", "rank")


def highest_quotients(parties: DataFrame, votes: str, seats: str, name: str, group: list[str], tie: str, most: str | None = None) -> DataFrame:
    """Sainte-Lague: the column ``name`` gets each party's part of the ``seats`` (a column, equal within ``group``).

    With v votes in all, s seats and n parties, the divisor v / (s + n/2) gives at least s seats by rounding and
    v / (s - n/2) at most s. Only the quotients between the two, about 2n a group, are ranked; the rest of the order is
    known. ``most`` is a column with a party's greatest number of seats, applied afterwards.
    """
    where = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, v, s = F.count(F.lit(1)).over(where), F.sum(votes).over(where), F.col(seats)
    bounds = parties.withColumn("_v", v).withColumn("_n", n)
    rounded = lambda divisor: F.floor(F.col(votes) / divisor + 0.5)
    low = F.when((s * 2 > F.col("_n")) & (F.col("_v") > 0), rounded(F.col("_v") / (s - F.col("_n") / 2)))
    high = F.when(F.col("_v") > 0, rounded(F.col("_v") / (s + F.col("_n") / 2)))
    bounds = bounds.withColumn("_low", F.coalesce(low, F.lit(0)).cast("long")).withColumn("_high", F.coalesce(high, F.lit(0)).cast("long"))
    bounds = bounds.withColumn("_left", s - F.sum("_low").over(where))
    open_seats = bounds.withColumn("_k", F.explode(F.expr("if(_high > _low, sequence(_low, _high - 1), array())")))
    by_quotient = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    place = F.row_number().over(by_quotient.orderBy((F.col(votes) / (F.col("_k") * 2 + 1)).desc(), tie, "_k"))
    won = open_seats.withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    keys = [*group, tie] if tie not in group else group
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    out = bounds.join(won, keys, "left").withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0)))
    if most:
        out = out.withColumn(name, F.least(name, most))
    return out.drop("_v", "_n", "_low", "_high", "_left", "_won")


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: int = 3,
    block_tokens: int = 16,
    shard_tokens: int = 30_000,
    max_shards: int = 4096,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """A row a document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` (its source's), ``taken`` (tokens
    of the document in the mix, repeats counted), ``shard``, ``copies`` (taken / size, rounded half up).

    Null texts count 0 tokens and nothing is taken of them; a null source is one source, last in order; null and
    repeated ids are rows like any others (of rows alike in id, source and size it is not said which gives the tokens
    at a block's edge, so the result as a bag of rows is the same each time). An empty table gives no rows. Extra columns
    are ignored.
    """
    names = {"doc_id": F.col(id_column), "source": F.col(source_column), "size": word_count(F.col(text_column))}
    sized = materialize(df.select(*[c.alias(k) for k, c in names.items()]), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, max_repeats)
    total = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("all_seats", F.round(F.sum("target").over(total) / block_tokens).cast("long"))
    sources = highest_quotients(sources, "target", "all_seats", "seats", [], "rank").drop("all_seats")
    share = F.col("source_size") * max_shards / F.greatest(F.sum("source_size").over(total), F.lit(1))
    shards = F.least(F.ceil(F.col("source_size") / shard_tokens), F.ceil(share))
    sources = materialize(sources.withColumn("shards", F.greatest(shards, F.lit(1)).cast("long")), "mix-sources")

    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = sized.join(sources.select("source", "shards", "rank"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("draw", draw).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("draw")), F.col("shards")))
    cells = rows.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.join(sources.select("rank", "seats"), "rank")
    cells = cells.withColumn("blocks", F.ceil(F.col("shard_size") / block_tokens).cast("long")).withColumn("most", F.col("blocks") * max_repeats)
    cells = highest_quotients(cells, "shard_size", "seats", "quota", ["rank"], "shard", "most")
    per_block = F.floor(F.col("quota") / F.greatest("blocks", F.lit(1)))
    cells = cells.select(
        "rank", "shard", per_block.alias("every"), (F.col("quota") - per_block * F.col("blocks")).alias("more"), "blocks",
        F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.greatest("blocks", F.lit(1))).alias("first"),
    )
    rows = rows.join(cells, ["rank", "shard"])
    stream = Window.partitionBy("rank", "shard").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("size"))

    def within(low: Column, high: Column) -> Column:
        """Tokens of [start, end) that lie in the blocks from low up to high."""
        return F.greatest(F.least(F.col("end"), high * block_tokens) - F.greatest(F.col("start"), low * block_tokens), F.lit(0))

    last = F.col("first") + F.col("more")
    taken = F.col("every") * F.col("size") + within(F.col("first"), F.least(last, F.col("blocks")))
    taken = (taken + within(F.lit(0).cast("long"), last - F.col("blocks"))).cast("long")
    rows = rows.withColumn("taken", taken).join(sources.select("rank", "source_size", "target"), "rank")
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "shard", copies.alias("copies"))


def mixed_documents(df: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix in whole copies: each row of ``df`` as often as ``copies`` of :func:`mix` says.

    Rows are known by a hash of all their columns; those that agree in all of them get the rounded mean of their copies.
    Texts are shuffled once, to meet their copies, unless the plan is small enough to be broadcast; rows that agree in a
    thousandth of all are never shuffled. Columns may have any names.
    """
    given = df.columns
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"), F.xxhash64(*[F.col(f"`{c}`") for c in given]).alias("row"))
    columns = {name: parameters.pop(f"{name}_column", name) for name in ("text", "source")}
    plan = mix(keyed.select("row", *[F.col(f"given.`{c}`").alias(name) for name, c in columns.items()]), id_column="row", **parameters)
    plan = plan.groupBy(F.col("doc_id").alias("row")).agg(F.round(F.avg("copies")).cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(keyed, hold(plan.where("copies > 0")), "row", "n")
    return joined.select("given", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("given.*")
