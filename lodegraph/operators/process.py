"""Execution flows: entry points, traces, their deduplication, processes and steps."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, capital, half_up
from ..graph import fan
from .iterate import cut, first_by

#: Names that mark entry points, names that mark helpers, and paths of test files.
ENTRY_NAMES = (
    "(?i)^(main|init|bootstrap|start|run|setup|configure)$", "^handle[A-Z]", "^on[A-Z]", "Handler$", "Controller$", "^process[A-Z]",
    "^execute[A-Z]", "^perform[A-Z]", "^dispatch[A-Z]", "^trigger[A-Z]", "^emit[A-Z]", "^use[A-Z]", "^app$", "^view_", "^do[A-Z]", "Service$",
)
HELPER_NAMES = (
    "^(get|set|is|has|can|should|will|did)[A-Z]", "^_", "(?i)^(format|parse|validate|convert|transform)", "(?i)^(log|debug|error|warn|info)$",
    "^(to|from)[A-Z]", "Helper$", "Util$", "Utils$",
)
TEST_PATHS = (
    r"\.test\.", r"\.spec\.", "__tests__", "__mocks__", "/test/", "/tests/", r"_test\.py$", r"_test\.go$", r"_spec\.rb$", r"Test\.java$", r"Tests\.cs$",
)


def is_test_file(path: Column) -> Column:
    """F13."""
    return F.coalesce(any_of(path, TEST_PATHS), F.lit(False))


def framework_bonus(path: Column, version: int = 1) -> Column:
    """What a path that a framework starts from multiplies a score by."""
    p = F.coalesce(path, F.lit(""))
    if version == 1:
        return F.when(p.contains("/pages/") | p.contains("/app/") | p.endswith("views.py"), 2.0).otherwise(1.0)
    p = F.lower(p)
    most = (p.contains("/pages/") & ~p.contains("/api/")) | (p.contains("/app/") & p.contains("page.tsx"))
    routed = p.contains("/routes/") | p.contains("/controllers/")
    main = p.rlike(r"views\.py$|controller\.java$|/main\.(go|rs|py)$")
    return F.when(most, 3.0).when(routed, 2.5).when(main, 3.0).otherwise(1.0)


def entry_scores(nodes: DataFrame, calls: DataFrame, version: int = 1) -> DataFrame:
    """M9: the nodes with ``fan_out``, ``fan_in``, ``score`` and ``reasons``; 0 for a node that calls nothing."""
    counted = nodes.join(fan(nodes.select("id"), calls), "id")
    helper, entry = any_of(F.col("name"), HELPER_NAMES), any_of(F.col("name"), ENTRY_NAMES)
    base = F.col("fan_out") / (F.col("fan_in") + 1)
    bonus = framework_bonus(F.col("file_path"), version)
    exported = F.coalesce("is_exported", F.lit(False))
    score = base * F.when(exported, 2.0).otherwise(1.0) * F.when(helper, 0.3).when(entry, 1.5).otherwise(1.0) * bonus
    reasons = F.array_compact(F.array(
        F.concat(F.lit("base:"), F.format_string("%.2f", base)), F.when(exported, "exported"),
        F.when(helper, "utility-pattern").when(entry, "entry-pattern"), F.when(bonus > 1, "framework"),
    ))
    calls_none = F.col("fan_out") == 0
    return counted.withColumn("score", F.when(calls_none, 0.0).otherwise(score)).withColumn("reasons", F.when(calls_none, F.array(F.lit("no-outgoing-calls"))).otherwise(reasons))


def entry_points(nodes: DataFrame, calls: DataFrame, limit: int = 200, version: int = 1, skip_tests: bool = True) -> DataFrame:
    """The ``limit`` functions and methods of highest score above 0, outside of tests, with ``rank`` from 1."""
    kept = nodes.where(F.col("kind").isin("Function", "Method"))
    kept = kept.where(~is_test_file(F.col("file_path"))) if skip_tests else kept
    best = entry_scores(kept, calls, version).where("score > 0").orderBy(F.desc("score"), "ord").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))


def callees(calls: DataFrame, min_confidence: float = 0.5, branching: int = 4) -> DataFrame:
    """O3: each caller's first calls, in order: ``src``, ``dst``, ``place``. Parallel calls take a place each."""
    order = Window.partitionBy("source_id").orderBy("ord", "target_id")
    sure = calls.where((F.col("kind") == "CALLS") & (F.col("confidence") >= min_confidence))
    return sure.withColumn("place", F.row_number().over(order)).where(F.col("place") <= branching).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "place")


def traces(entries: DataFrame, calls: DataFrame, max_depth: int = 10, branching: int = 4, min_steps: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """The flows from each entry (``entry``): ``entry``, ``trace`` (array of ids) and ``place`` among the entry's,
    at most ``3 * branching`` each.

    Breadth first over the first ``branching`` calls of a node. A node is expanded once an entry, on the path that came to
    it first; a path ends, and counts if it has ``min_steps`` nodes, at a node that calls nothing, at the depth limit, or
    where all that is left leads back into itself. All entries advance level by level together; ``way``, the places taken
    so far, orders paths as a queue would.
    """
    first = cut(callees(calls, min_confidence, branching))
    callers = first.select(F.col("src").alias("node")).distinct()
    front = entries.select("entry", F.col("entry").alias("node"), F.array("entry").alias("path"), F.array().cast("array<int>").alias("way"))
    seen, done = None, None
    for depth in range(max_depth + 1):
        popped = first_by(front, ["entry", "node"], F.col("way"))
        if seen is not None:
            popped = popped.join(seen, ["entry", "node"], "left_anti")
        popped = cut(popped.join(callers.withColumn("calls", F.lit(True)), "node", "left"))
        if popped.isEmpty():
            break
        ended = popped.where(F.col("calls").isNull()) if depth < max_depth else popped
        if depth < max_depth:
            open_paths = popped.where("calls")
            grown = open_paths.join(first.withColumnRenamed("src", "node"), "node").where(~F.array_contains("path", F.col("dst")))
            front = cut(grown.select("entry", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("place")).alias("way"), F.col("node").alias("from")))
            stuck = open_paths.join(front.select("entry", F.col("from").alias("node")).distinct(), ["entry", "node"], "left_anti")
            ended = ended.unionByName(stuck)
            front = front.drop("from")
        rows = ended.where(F.size("path") >= min_steps).select("entry", F.col("path").alias("trace"), F.lit(depth).alias("depth"), "way")
        done = rows if done is None else done.unionByName(rows)
        met = popped.select("entry", "node")
        # the entry itself may be come back to once: its first visit does not count as one
        met = met.where("entry <> node") if depth == 0 else met
        seen = met if seen is None else seen.unionByName(met)
        if depth == max_depth:
            break
    if done is None:  # there are no entries
        return entries.select("entry", F.array("entry").alias("trace"), F.lit(1).alias("place")).limit(0)
    order = Window.partitionBy("entry").orderBy("depth", "way")
    return done.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3 * branching).select("entry", "trace", "place")


def ranked(found: DataFrame, entries: DataFrame) -> DataFrame:
    """All traces, longest first; of equal length by entry rank, then place: column ``rank1``."""
    joined = found.join(entries.select(F.col("id").alias("entry"), F.col("rank").alias("entry_rank")), "entry")
    return joined.withColumn("rank1", F.row_number().over(Window.orderBy(F.desc(F.size("trace")), "entry_rank", "place")))


#: Ids in a row by which a trace is looked for in others, and how many characters of the ids at its ends, as many as they have.
INNER, ENDS = 4, (24, 8, 2, 1)


def drop_contained(traces_ranked: DataFrame) -> DataFrame:
    """Without traces whose joined text lies within that of an earlier, so at least as long, trace.

    Containment is transitive, so it does not matter whether the earlier trace is kept itself. Within the joined text of
    another, a trace of two ids and more begins with the end of an id, goes on with whole ids, and ends with the beginning
    of one. So it is looked for by the end of its first id, up to INNER whole ones, and the beginning of the next, all
    three together; every trace is known by all such pieces of its own. A trace of one id is looked for by its beginning,
    at every place of every id. Only traces that share a piece are compared.
    """
    keyed = traces_ranked.select("rank1", F.concat_ws("->", "trace").alias("text"))
    keyed = keyed.select("rank1", "text", F.split("text", "->").alias("ids"))
    length = lambda size, *of: functools.reduce(operator.and_, (F.length(c) >= size for c in of))

    def piece(ids: Column, at: Column, inner: Column, size: int) -> Column:
        """The hash of the end of the id at a place (from 1), the whole ids after it, and the beginning of the next."""
        before, after = F.get(ids, at - 1), F.get(ids, at + inner)
        return F.xxhash64(inner, F.lit(size), F.right(before, F.lit(size)), F.array_join(F.slice(ids, at + 1, inner), "->"), F.left(after, F.lit(size)))

    n = F.size("ids")
    inner = F.least(n - 2, F.lit(INNER))
    several = keyed.where(n > 1)
    own = F.lit(None).cast("bigint")
    for size in reversed(ENDS):
        own = F.when(length(size, F.get("ids", F.lit(0)), F.get("ids", inner + 1)), piece(F.col("ids"), F.lit(1), inner, size)).otherwise(own)
    bare = F.xxhash64(inner, F.lit(0), F.array_join(F.slice("ids", F.lit(2), inner), "->"))  # an end without characters
    asked = several.select("rank1", "text", F.coalesce(own, bare).alias("piece"))
    places = several.select("rank1", "ids", F.explode(F.sequence(F.lit(1), n - 1)).alias("at"))
    places = places.select("rank1", "ids", "at", F.explode(F.sequence(F.lit(0), F.least(F.size("ids") - F.col("at") - 1, F.lit(INNER)))).alias("inner"))
    before, after = F.get("ids", F.col("at") - 1), F.get("ids", F.col("at") + F.col("inner"))
    made = [F.when(length(size, before, after), piece(F.col("ids"), F.col("at"), F.col("inner"), size)) for size in ENDS]
    made.append(F.xxhash64("inner", F.lit(0), F.array_join(F.slice("ids", F.col("at") + 1, F.col("inner")), "->")))
    sought = asked.select("piece").distinct()
    holders = places.select(F.col("rank1").alias("by"), F.explode(F.array_compact(F.array(*made))).alias("piece")).join(sought, "piece", "left_semi").distinct()
    pairs = asked.join(holders, "piece").where(F.col("by") < F.col("rank1")).select("rank1", "text", "by")
    # traces of one id, or of none
    begun = lambda text: functools.reduce(lambda other, size: F.when(F.length(text) >= size, F.concat(F.lit(f"{size}:"), F.left(text, F.lit(size)))).otherwise(other), reversed(ENDS), F.lit(""))
    single = keyed.where(n <= 1).select("rank1", "text", begun(F.col("text")).alias("piece"))
    nodes = keyed.select(F.col("rank1").alias("by"), F.explode(F.array_distinct("ids")).alias("id"))
    tails = nodes.select("id").distinct().select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))), lambda i: F.substr(F.col("id"), i))).alias("tail"))
    parts = F.array_compact(F.array(*[F.when(F.length("tail") >= size, F.concat(F.lit(f"{size}:"), F.left("tail", F.lit(size)))) for size in ENDS], F.lit("")))
    tails = tails.select("id", F.explode(parts).alias("piece")).distinct().join(single.select("piece").distinct(), "piece", "left_semi")
    in_ids = single.join(tails, "piece").where(F.col("id").contains(F.col("text"))).join(nodes, "id").where(F.col("by") < F.col("rank1")).select("rank1", "text", "by")
    held = pairs.join(keyed.select(F.col("rank1").alias("by"), F.col("text").alias("long")), "by").where(F.col("long").contains(F.col("text")))
    gone = held.select("rank1").unionAll(in_ids.select("rank1")).distinct()
    return traces_ranked.join(gone, "rank1", "left_anti")


def longest_by_ends(traces_ranked: DataFrame) -> DataFrame:
    """The longest trace for each pair of first and last node, of equals the first."""
    ends = Window.partitionBy(F.col("trace")[0], F.element_at("trace", -1)).orderBy(F.desc(F.size("trace")), "rank1")
    return traces_ranked.withColumn("_n", F.row_number().over(ends)).where("_n = 1").drop("_n")


def processes(nodes: DataFrame, edges: DataFrame, memberships: DataFrame | None = None, max_entries: int = 150, max_processes: int = 75, capitals: bool = False, **limits) -> DataFrame:
    """The flows kept, longest first: ``idx`` (from 0), ``id``, ``label``, ``detail``, ``process_type``,
    ``step_count``, ``entry_id``, ``terminal_id``, ``trace``, ``communities``. ``memberships`` has ``node_id``,
    ``community_id`` and ``ord``; of several the last counts (J18)."""
    calls = edges.where("kind = 'CALLS'")
    best = cut(entry_points(nodes, calls).where(F.col("rank") <= max_entries))
    found = traces(best.select(F.col("id").alias("entry")), calls, **limits)
    kept = cut(longest_by_ends(drop_contained(cut(ranked(found, best)))))
    order = (F.desc(F.size("trace")), F.col("rank1"))
    kept = kept.orderBy(*order).limit(max_processes).withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)
    named = kept.withColumn("entry_id", F.col("trace")[0]).withColumn("terminal_id", F.element_at("trace", -1))
    names = nodes.select("id", "name")
    named = named.join(names.withColumnsRenamed({"id": "entry_id", "name": "entry_name"}), "entry_id", "left").join(names.withColumnsRenamed({"id": "terminal_id", "name": "terminal_name"}), "terminal_id", "left")
    if memberships is None:
        named = named.withColumn("communities", F.array().cast("array<string>"))
    else:
        last = memberships.groupBy("node_id").agg(F.max_by("community_id", F.struct("ord", "community_id")).alias("community_id"))
        touched = named.select("idx", F.explode("trace").alias("node_id")).join(last, "node_id").groupBy("idx").agg(F.array_sort(F.collect_set("community_id")).alias("communities"))
        named = named.join(touched, "idx", "left").withColumn("communities", F.coalesce("communities", F.array().cast("array<string>")))
    show = (lambda c: capital(F.col(c), False)) if capitals else F.col
    label = F.concat_ws(" → ", show("entry_name"), show("terminal_name"))
    kind = F.when(F.size("communities") > 1, "cross_community").otherwise("intra_community")
    plain = F.lower(F.substring(F.regexp_replace("entry_name", "[^a-zA-Z0-9]", "_"), 1, 30))
    count = F.size("trace")
    detail = F.concat(F.when(kind == "cross_community", "🌐").otherwise("📦"), F.lit(" "), F.concat_ws(" → ", "entry_name", "terminal_name"), F.lit(" ("), count.cast("string"), F.lit(" steps)"))
    return named.select(
        "idx", F.concat(F.lit("proc_"), F.col("idx").cast("string"), F.lit("_"), plain).alias("id"), label.alias("label"), detail.alias("detail"),
        kind.alias("process_type"), count.alias("step_count"), "entry_id", "terminal_id", "trace", "communities",
    )


def process_steps(found: DataFrame) -> DataFrame:
    """``id``, ``step`` from 1, ``node_id``."""
    return found.select("id", F.posexplode("trace").alias("at", "node_id")).select("id", (F.col("at") + 1).alias("step"), "node_id")


def process_stats(found: DataFrame, calls: DataFrame) -> DataFrame:
    """One row."""
    called = calls.where("kind = 'CALLS'").agg(F.count_distinct("target_id").alias("entry_points_found"))
    made = found.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("process_type") == "cross_community", 1)).alias("cross_community"),
        half_up(F.coalesce(F.avg("step_count"), F.lit(0.0)), 1).alias("avg_step_count"),
    )
    return made.join(called, F.lit(True))


def write_back(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Process nodes and STEP_IN_PROCESS edges; of a node's steps in a process the first."""
    nodes = found.select(F.concat(F.lit("Process:"), F.col("id")).alias("id"), F.lit("Process").alias("kind"), F.col("label").alias("name"))
    steps = process_steps(found).groupBy("id", "node_id").agg(F.min("step").alias("step"))
    target = F.concat(F.lit("Process:"), F.col("id"))
    edges = steps.select(F.concat(F.col("node_id"), F.lit("->"), target, F.lit(":STEP_IN_PROCESS")).alias("id"), F.col("node_id").alias("source_id"), target.alias("target_id"), F.lit("STEP_IN_PROCESS").alias("kind"), F.lit(1.0).alias("confidence"), "step")
    return nodes, edges
