"""Queries over the graph's shape: traversals, paths, communities, processes, inheritance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import community, heritage, process, traverse
from ..operators.iterate import cut
from .register import query
from .relational import ROOTS, roots


def walk_sql(ways: str, depth: int) -> str:
    """Reached nodes as a recursive query: the roots, and up to ``depth`` steps over ``ways`` (a, b)."""
    return f"{ways}, walk AS (SELECT root, root AS node, 0 AS depth FROM fx_roots UNION SELECT root, b, depth + 1 FROM walk JOIN ways ON a = node AND a <> b WHERE depth < {depth}), reached AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)"


OUT = "ways AS (SELECT source_id AS a, target_id AS b FROM fx_calls)"
IN = "ways AS (SELECT target_id AS a, source_id AS b FROM fx_calls)"
BOTH = "ways AS (SELECT source_id AS a, target_id AS b FROM fx_calls UNION SELECT target_id, source_id FROM fx_calls)"
REACHED = "SELECT root, node, depth FROM reached WHERE depth > 0"


def impact(fx, *how, **more):
    """What the roots reach, worked out by number."""
    return traverse.impact(fx.numbered_nodes, fx.numbered_calls, numbered_roots(fx), *how, **more, names=fx.numbers)


def numbered_roots(fx):
    return fx.numbers.where("ord % 100 = 0").select(F.col("n").alias("root"))


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(OUT, 5)}")
def impact_downstream(fx):
    return impact(fx, "downstream", 5)


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(IN, 5)}")
def impact_upstream(fx):
    return impact(fx, "upstream", 5)


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(BOTH, 3)}")
def impact_both(fx):
    return impact(fx, "both", 3)


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(IN, 3)}")
def impact_both_compat(fx):
    return impact(fx, "both", 3, strict_compat=True)


@query("SELECT root, depth, count(*) AS n, string_agg(node, ',' ORDER BY node) AS nodes FROM reached WHERE depth > 0 GROUP BY root, depth", "fx_calls", extra=f"{ROOTS}, {walk_sql(OUT, 4)}")
def impact_by_depth(fx):
    told = traverse.by_depth(impact(fx, "downstream", 4, by_block=True))
    return told.select("root", "depth", "n", F.array_join("nodes", ",").alias("nodes"))


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(BOTH, 2)}")
def khop_undirected(fx):
    return traverse.khop(fx.fx_calls, roots(fx), 2, "both")


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(BOTH, 2)}")
def khop_exclusive(fx):
    return traverse.khop_exclusive(fx.fx_calls, roots(fx), 3)


@query("SELECT root, node, depth FROM reached", "fx_calls", extra=f"{ROOTS}, {walk_sql(BOTH, 1)}")
def find_connected(fx):
    return traverse.khop_exclusive(fx.fx_calls, roots(fx), 2, include_start=True)


@query(REACHED, "fx_calls", extra=f"{ROOTS}, {walk_sql(OUT, 3)}")
def hops_directed(fx):
    return traverse.khop(fx.fx_calls, roots(fx), 3, "out")


@query(
    """SELECT front.root, 'callee' AS role, c.target_id AS node, 'CALLS' AS via, front.depth + 1 AS depth FROM down AS front JOIN fx_calls c ON c.source_id = front.node WHERE front.depth < 2
       UNION ALL SELECT front.root, 'caller', c.source_id, 'CALLS', front.depth + 1 FROM up AS front JOIN fx_calls c ON c.target_id = front.node WHERE front.depth < 2""",
    "fx_calls",
    extra=f"""{ROOTS}, d0 AS (SELECT root, root AS node, 0 AS depth FROM fx_roots UNION SELECT root, target_id, depth + 1 FROM d0 JOIN fx_calls ON source_id = node WHERE depth < 2),
      u0 AS (SELECT root, root AS node, 0 AS depth FROM fx_roots UNION SELECT root, source_id, depth + 1 FROM u0 JOIN fx_calls ON target_id = node WHERE depth < 2),
      down AS (SELECT root, node, min(depth) AS depth FROM d0 GROUP BY root, node), up AS (SELECT root, node, min(depth) AS depth FROM u0 GROUP BY root, node)""",
)
def context_360(fx):
    return traverse.context(fx.fx_nodes, fx.fx_calls, roots(fx), 2)


#: Each start is paired with itself and with the starts so many places on: pairs grow with the nodes, not their square.
PLACES_ON = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)
PAIRS = f"""fx_pairs AS (SELECT a.id AS src, b.id AS dst FROM fx_nodes a JOIN (SELECT unnest({list(PLACES_ON)}) AS k) v ON a.ord % 100 = 0 JOIN fx_nodes b ON b.ord = a.ord + 100 * k
   UNION SELECT root, 'Function:none' FROM fx_roots)"""


def pairs(fx):
    """Stated pairs: each start with itself, with starts some places on, and with a node that is not there."""
    starts = fx.fx_nodes.where("ord % 100 = 0").select(F.col("id").alias("src"), "ord")
    on = starts.select("src", "ord", F.explode(F.array(*map(F.lit, PLACES_ON))).alias("k")).select("src", (F.col("ord") + 100 * F.col("k")).alias("ord"))
    return on.join(starts.withColumnRenamed("src", "dst"), "ord").select("src", "dst").unionAll(starts.select("src", F.lit("Function:none").alias("dst")))


def pair_names(fx):
    """The numbers of the nodes, and one for the node that is not there: a pair of it has a length too, if to itself."""
    none = fx.spark.createDataFrame([("Function:none", -1)], "id string, n bigint")
    return fx.numbers.select("id", "n").unionAll(none)


def away_sql(name: str, ways: str) -> str:
    """How far every node is from each target (dst) of the pairs over ``ways`` (a, b), in any number of steps."""
    return f"""{name}(dst, node, depth) USING KEY (dst, node) AS (SELECT DISTINCT dst, dst, 0 FROM fx_pairs UNION
   SELECT x.dst, w.a, min(x.depth) + 1 FROM {name} x JOIN {ways} w ON w.b = x.node LEFT JOIN recurring.{name} r ON r.dst = x.dst AND r.node = w.a WHERE r.node IS NULL GROUP BY x.dst, w.a)"""


CALLED = "called AS (SELECT DISTINCT source_id AS a, target_id AS b FROM fx_calls WHERE source_id <> target_id)"
SHORTEST = f"""{ROOTS}, {PAIRS}, {CALLED}, {away_sql("away", "called")},
 walked(src, dst, tip, path, near) AS (SELECT p.src, p.dst, p.src, [p.src], y.depth FROM fx_pairs p JOIN away y ON y.dst = p.dst AND y.node = p.src
   UNION ALL SELECT k.src, k.dst, min(w.b), list_append(any_value(k.path), min(w.b)), any_value(k.near) - 1 FROM walked k JOIN called w ON w.a = k.tip JOIN away y ON y.dst = k.dst AND y.node = w.b AND y.depth = k.near - 1 WHERE k.near > 0 GROUP BY k.src, k.dst)"""


@query("SELECT p.src, p.dst, CAST(coalesce(len(k.path) - 1, -1) AS INT) AS length, coalesce(array_to_string(k.path, ' > '), '') AS path FROM fx_pairs p LEFT JOIN walked k ON k.src = p.src AND k.dst = p.dst AND k.near = 0", "fx_calls", extra=SHORTEST)
def shortest_path_nodes(fx):
    return traverse.shortest_paths(fx.numbered_calls, pairs(fx), names=pair_names(fx)).select("src", "dst", "length", F.array_join("path", " > ").alias("path"))


@query("SELECT p.src, p.dst, CAST(coalesce(y.depth, -1) AS INT) AS length FROM fx_pairs p LEFT JOIN away y ON y.node = p.src AND y.dst = p.dst", "fx_calls",
       extra=f"""{ROOTS}, {PAIRS}, {CALLED}, two AS (SELECT a, b FROM called UNION SELECT b, a FROM called), {away_sql("away", "two")}""")
def shortest_path_undirected(fx):
    return traverse.shortest_paths(fx.numbered_calls, pairs(fx), False, names=pair_names(fx)).select("src", "dst", "length")


@query("SELECT src, dst, array_to_string(path, ' > ') AS path FROM grown WHERE tip = dst AND len(path) > 1", "fx_calls",
       extra=f"""{ROOTS}, {PAIRS}, {CALLED}, {away_sql("away", "called")}, steps AS (SELECT source_id AS a, target_id AS b FROM fx_calls),
       grown AS (SELECT src, dst, src AS tip, [src] AS path FROM fx_pairs WHERE src <> dst UNION ALL SELECT g.src, g.dst, s.b, list_append(g.path, s.b) FROM grown g JOIN steps s ON s.a = g.tip JOIN away y ON y.dst = g.dst AND y.node = s.b
         WHERE g.tip <> g.dst AND NOT list_contains(g.path, s.b) AND len(g.path) + y.depth <= 5)""")  # fmt: skip
def all_simple_paths(fx):
    return traverse.all_paths(fx.numbered_calls, pairs(fx), names=fx.numbers).select("src", "dst", F.array_join("path", " > ").alias("path"))


# --- communities ---


def weights(fx):
    return community.call_weights(fx.fx_nodes, fx.fx_calls)


def groups(fx):
    return fx.fx_groups


#: The least label among the neighbours, until none gets lower.
LABELS = """comp(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM fx_weights UNION
  SELECT r.node, min(c.component) FROM comp c JOIN fx_weights w ON w.b = c.node JOIN recurring.comp r ON r.node = w.a WHERE c.component < r.component GROUP BY r.node)"""


@query("SELECT a, b, round(w, 4) AS w FROM fx_weights", "fx_weights")
def community_graph(fx):
    return weights(fx).select("a", "b", F.round("w", 4).alias("w"))


@query("SELECT a AS id, round(sum(w), 4) AS degree, count(*) AS neighbours FROM fx_weights GROUP BY a", "fx_weights")
def degree_weighted(fx):
    return community.weighted_degrees(weights(fx)).select("id", F.round("degree", 4).alias("degree"), "neighbours")


@query("SELECT node, component FROM comp", "fx_weights", extra=LABELS)
def connected_components(fx):
    return community.components(weights(fx))


@query()
def louvain_communities(fx):
    return community.clusters(fx.numbered_weights, names=fx.numbers)


@query(
    """SELECT g.component, count(DISTINCT g.node) AS size, round(CASE WHEN count(DISTINCT g.node) < 2 OR count(w.b) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE h.component = g.component) / CAST(count(w.b) AS DOUBLE) END, 6) AS cohesion
       FROM fx_groups g LEFT JOIN fx_weights w ON w.a = g.node LEFT JOIN fx_groups h ON h.node = w.b GROUP BY g.component""",
    "fx_weights", "fx_groups",
)
def community_cohesion(fx):
    return community.cohesion(weights(fx), groups(fx)).select("component", "size", F.round("cohesion", 6).alias("cohesion"))


@query(
    """SELECT count(*) AS communities, CAST(sum(size) AS BIGINT) AS nodes, round(avg(c), 6) AS average_cohesion FROM (
       SELECT count(DISTINCT g.node) AS size, CASE WHEN count(DISTINCT g.node) < 2 OR count(w.b) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE h.component = g.component) / CAST(count(w.b) AS DOUBLE) END AS c
       FROM fx_groups g LEFT JOIN fx_weights w ON w.a = g.node LEFT JOIN fx_groups h ON h.node = w.b GROUP BY g.component) AS u""",
    "fx_weights", "fx_groups",
)
def community_totals(fx):
    return community.totals(weights(fx), groups(fx)).select("communities", "nodes", F.round("average_cohesion", 6).alias("average_cohesion"))


@query(
    """SELECT component, size, round(i, 4) AS internal, round(e, 4) AS external, round(CASE WHEN size > 1 THEN 2 * i / (size * (size - 1)) ELSE 0 END, 6) AS density, round(i / (i + e + 1), 6) AS cohesion FROM (
       SELECT g.component, count(DISTINCT g.node) AS size, coalesce(sum(w.w / 2) FILTER (WHERE h.component = g.component), 0) AS i, coalesce(sum(w.w) FILTER (WHERE h.component <> g.component), 0) AS e
       FROM fx_groups g LEFT JOIN fx_weights w ON w.a = g.node LEFT JOIN fx_groups h ON h.node = w.b GROUP BY g.component) AS u""",
    "fx_weights", "fx_groups",
)
def cluster_stats(fx):
    r = lambda c, n: F.round(c, n).alias(c)
    return community.cluster_stats(weights(fx), groups(fx)).select("component", "size", r("internal", 4), r("external", 4), r("density", 6), r("cohesion", 6))


@query(
    """SELECT round(coalesce((SELECT sum(w) FROM fx_weights w JOIN fx_groups g ON g.node = a JOIN fx_groups h ON h.node = b WHERE g.component = h.component), 0) / t - (SELECT sum(m * m) FROM mass) / (t * t), 6) AS q,
       round((SELECT count(*) FROM fx_weights w JOIN fx_groups g ON g.node = a JOIN fx_groups h ON h.node = b WHERE g.component = h.component) / CAST(2 * (SELECT count(*) FROM fx_groups) AS DOUBLE), 6) AS share FROM total""",
    "fx_weights", "fx_groups",
    extra="total AS (SELECT sum(w) AS t FROM fx_weights), mass AS (SELECT sum(w) AS m FROM fx_weights JOIN fx_groups ON node = a GROUP BY component)",
)
def modularity(fx):
    a, b = community.modularity(weights(fx), groups(fx)), community.neighbour_share(weights(fx), groups(fx))
    return a.join(b.withColumnRenamed("q", "share"), F.lit(True)).select(F.round("q", 6).alias("q"), F.round("share", 6).alias("share"))


@query(
    """SELECT component, concat(upper(substr(folder, 1, 1)), lower(substr(folder, 2))) AS label FROM (
       SELECT component, arg_min(folder, (-n, first)) AS folder FROM (SELECT g.component, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder, count(*) AS n, min(ord) AS first
       FROM fx_groups g JOIN fx_nodes ON id = node GROUP BY 1, 2) AS u GROUP BY component) AS v""",
    "fx_groups",
)
def community_label(fx):
    return community.labels(groups(fx), fx.fx_nodes)


SETS = "sets AS (SELECT DISTINCT concat('b', p_brand) AS component, concat(p_type, CAST(p_size AS STRING)) AS member FROM part)"


def _sets(fx):
    return fx.table("part").select(F.concat(F.lit("b"), "p_brand").alias("component"), F.concat("p_type", F.col("p_size").cast("string")).alias("member")).distinct()


@query("SELECT a, b, shared, round(shared / CAST(na + nb - shared AS DOUBLE), 6) AS jaccard FROM (SELECT x.component AS a, y.component AS b, count(*) AS shared FROM sets x JOIN sets y ON x.member = y.member WHERE x.component < y.component GROUP BY 1, 2) AS u JOIN (SELECT component, count(*) AS na FROM sets GROUP BY 1) p ON p.component = a JOIN (SELECT component, count(*) AS nb FROM sets GROUP BY 1) q ON q.component = b", extra=SETS)
def cluster_jaccard(fx):
    return community.similarities(_sets(fx)).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query()
def cluster_merge(fx):
    sets = _sets(fx).groupBy("component").agg(F.sort_array(F.collect_list("member")).alias("members"))
    told = community.merge_similar(sets.select("component", F.xxhash64("component").alias("ord"), "members", F.lit(0.5).alias("cohesion")))
    return told.select("component", F.array_join("merged", ",").alias("merged"), F.array_join("members", ",").alias("members"), "symbol_count", "cohesion")


@query("SELECT target_id AS community, n.kind, count(*) AS n FROM fx_member m JOIN fx_nodes n ON n.id = m.source_id GROUP BY 1, 2", "fx_member")
def community_members(fx):
    return fx.fx_member.join(fx.fx_nodes.select(F.col("id").alias("source_id"), F.col("kind").alias("k")), "source_id").groupBy(F.col("target_id").alias("community"), F.col("k").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- processes ---

def _matches(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


SCORES = f"""deg AS (SELECT n.*, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i FROM fx_named n LEFT JOIN (SELECT source_id, count(*) AS n FROM fx_calls GROUP BY source_id) o ON o.source_id = n.id
   LEFT JOIN (SELECT target_id, count(*) AS n FROM fx_calls GROUP BY target_id) i ON i.target_id = n.id),
 scores AS (SELECT *, CASE WHEN o = 0 THEN 0.0::DOUBLE ELSE o / CAST(i + 1 AS DOUBLE) * CASE WHEN coalesce(is_exported, false) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
   * CASE WHEN {_matches("name", process.HELPER_NAMES)} THEN 0.3::DOUBLE WHEN {_matches("name", process.ENTRY_NAMES)} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
   * CASE WHEN contains(file_path, '/pages/') OR contains(file_path, '/app/') OR ends_with(file_path, 'views.py') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END AS score FROM deg),
 entries AS (SELECT id, name, ord, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM scores WHERE kind IN ('Function', 'Method') AND score > 0 AND NOT {_matches("file_path", process.TEST_PATHS)} ORDER BY score DESC, ord LIMIT 200)"""


@query("SELECT id, o AS fan_out, i AS fan_in, round(score, 6) AS score FROM scores", "fx_calls", "fx_named", extra=SCORES)
def entry_point_scores(fx):
    return process.entry_scores(fx.fx_named, fx.fx_calls).select("id", "fan_out", "fan_in", F.round("score", 6).alias("score"))


@query("SELECT id, rank, round(score, 6) AS score FROM entries", "fx_calls", "fx_named", extra=SCORES)
def entry_points(fx):
    return process.entry_points(fx.fx_named, fx.fx_calls).select("id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT source_id AS src, target_id AS dst, place FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY ord, target_id) AS place FROM fx_calls WHERE confidence >= 0.5) AS u WHERE place <= 4", "fx_calls")
def first_callees(fx):
    return process.callees(fx.fx_calls).select("src", "dst", F.col("place").cast("long").alias("place"))


#: The flows of an entry: level by level, each node once an entry, from the path that a queue would bring to it first.
TRACES = f"""{SCORES},
 firsts AS (SELECT src, dst, place FROM (SELECT source_id AS src, target_id AS dst, row_number() OVER (PARTITION BY source_id ORDER BY ord, target_id) AS place FROM fx_calls WHERE confidence >= 0.5) AS u WHERE place <= 4),
 popped(entry, node, path, way, depth) USING KEY (entry, node) AS (SELECT id, id, [id], CAST([] AS BIGINT[]), 0 FROM entries WHERE rank <= 150 UNION
   SELECT p.entry, f.dst, arg_min(list_append(p.path, f.dst), list_append(p.way, f.place)), min(list_append(p.way, f.place)), p.depth + 1 FROM popped p JOIN firsts f ON f.src = p.node
   LEFT JOIN recurring.popped r ON r.entry = p.entry AND r.node = f.dst WHERE r.node IS NULL AND p.depth < 10 AND NOT list_contains(p.path, f.dst) GROUP BY p.entry, f.dst, p.depth),
 ended AS (SELECT p.entry, p.path, p.depth, p.way FROM popped p LEFT JOIN firsts f ON f.src = p.node GROUP BY ALL HAVING p.depth = 10 OR count(*) FILTER (WHERE f.dst IS NOT NULL AND NOT list_contains(p.path, f.dst)) = 0),
 traced AS (SELECT * FROM (SELECT entry, path, row_number() OVER (PARTITION BY entry ORDER BY depth, way) AS place FROM ended WHERE len(path) >= 3) AS u WHERE place <= 12)"""


def _traces(fx):
    best = cut(process.entry_points(fx.fx_named, fx.written_calls))
    return process.ranked(process.traces(best.where("rank <= 150").select(F.col("id").alias("entry")), fx.written_calls), best)


@query("SELECT entry, array_to_string(path, ' > ') AS trace, CAST(place AS INT) AS place FROM traced", "fx_calls", "fx_named", extra=TRACES)
def call_traces(fx):
    return _traces(fx).select("entry", F.array_join("trace", " > ").alias("trace"), "place")


MADE = """made AS (SELECT conv_id, string_agg(concat(role, CAST(len(string_split(text, ' ')) % 4 AS STRING)), '->' ORDER BY turn) AS k, count(*) AS n, min(concat(role, CAST(len(string_split(text, ' ')) % 4 AS STRING))) FILTER (WHERE turn = 0) AS head
   FROM conversations GROUP BY conv_id), ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, conv_id) AS rank1 FROM made)"""


def _talks(fx):
    """Conversations as traces: who spoke, and how long, turn by turn."""
    part = F.concat("role", (F.size(F.split("text", " ")) % 4).cast("string"))
    order = F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))
    traces = fx.table("conversations").groupBy("conv_id").agg(F.transform(order, lambda t: t["p"]).alias("trace"))
    return traces.withColumn("rank1", F.row_number().over(Window.orderBy(F.desc(F.size("trace")), "conv_id")))


@query("SELECT conv_id, k AS trace FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.rank1 < a.rank1 AND contains(b.k, a.k))", extra=MADE)
def trace_dedup(fx):
    return process.drop_contained(_talks(fx)).select("conv_id", F.concat_ws("->", "trace").alias("trace"))


@query("SELECT conv_id, n FROM (SELECT conv_id, n, row_number() OVER (PARTITION BY string_split(k, '->')[1], string_split(k, '->')[-1] ORDER BY rank1) AS r FROM ranked) AS u WHERE r = 1", extra=MADE)
def trace_endpoints(fx):
    return process.longest_by_ends(_talks(fx)).select("conv_id", F.size("trace").cast("long").alias("n"))


#: The flows that are kept: no part of an earlier one, the longest for each pair of ends, the 75 longest.
PROCESSES = f"""{TRACES},
 lined AS (SELECT t.entry, t.path, array_to_string(t.path, '->') AS k, len(t.path) AS n, row_number() OVER (ORDER BY len(t.path) DESC, e.rank, t.place) AS r FROM traced t JOIN entries e ON e.id = t.entry),
 apart AS (SELECT * FROM lined a WHERE NOT EXISTS (SELECT 1 FROM lined b WHERE b.r < a.r AND contains(b.k, a.k))),
 by_ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY n DESC, r) AS nth FROM apart) AS u WHERE nth = 1),
 flows AS (SELECT path, n, CAST(row_number() OVER (ORDER BY n DESC, r) - 1 AS INT) AS idx FROM by_ends ORDER BY n DESC, r LIMIT 75),
 own AS (SELECT source_id AS node, arg_max(target_id, (ord, target_id)) AS community FROM fx_member GROUP BY source_id),
 touched AS (SELECT idx, list_sort(list(DISTINCT community)) AS communities FROM (SELECT idx, unnest(path) AS node FROM flows) AS u JOIN own USING (node) GROUP BY idx),
 told AS (SELECT f.idx, f.path, f.n, a.name AS first_name, b.name AS last_name, coalesce(communities, []) AS communities, concat('proc_', CAST(f.idx AS STRING), '_', lower(substr(regexp_replace(a.name, '[^a-zA-Z0-9]', '_', 'g'), 1, 30))) AS id
   FROM flows f JOIN fx_named a ON a.id = f.path[1] JOIN fx_named b ON b.id = f.path[-1] LEFT JOIN touched t ON t.idx = f.idx)"""
FLOW = ("fx_calls", "fx_named", "fx_member")


def _processes(fx):
    return process.processes(fx.fx_named, fx.written_calls, fx.fx_member.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("community_id"), "ord"))


@query(
    """SELECT idx, id, concat(first_name, ' → ', last_name) AS label, concat(CASE WHEN len(communities) > 1 THEN '🌐' ELSE '📦' END, ' ', first_name, ' → ', last_name, ' (', CAST(n AS STRING), ' steps)') AS detail,
       CASE WHEN len(communities) > 1 THEN 'cross_community' ELSE 'intra_community' END AS process_type, CAST(n AS INT) AS step_count, path[1] AS entry_id, path[-1] AS terminal_id, array_to_string(path, ' > ') AS trace, array_to_string(communities, ',') AS communities FROM told""",
    *FLOW, extra=PROCESSES,
)
def processes(fx):
    return _processes(fx).select("idx", "id", "label", "detail", "process_type", "step_count", "entry_id", "terminal_id", F.array_join("trace", " > ").alias("trace"), F.array_join("communities", ",").alias("communities"))


@query("SELECT id, CAST(generate_subscripts(path, 1) AS INT) AS step, unnest(path) AS node_id FROM told", *FLOW, extra=PROCESSES)
def process_steps(fx):
    return process.process_steps(_processes(fx))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE len(communities) > 1) AS cross_community, floor(coalesce(avg(n), 0) * 10.0 + 0.5) / 10.0 AS avg_step_count, (SELECT count(DISTINCT target_id) FROM fx_calls) AS entry_points_found FROM told""",
    *FLOW, extra=PROCESSES,
)
def process_stats(fx):
    return process.process_stats(_processes(fx), fx.written_calls)


@query(
    """SELECT concat('Process:', id) AS id, 'Process' AS kind, 0 AS step FROM told
       UNION ALL SELECT concat(node, '->Process:', id, ':STEP_IN_PROCESS'), 'STEP_IN_PROCESS', CAST(min(step) AS INT) FROM (SELECT id, generate_subscripts(path, 1) AS step, unnest(path) AS node FROM told) AS u GROUP BY id, node""",
    *FLOW, extra=PROCESSES,
)
def process_write_back(fx):
    nodes, edges = process.write_back(_processes(fx))
    return nodes.select("id", "kind", F.lit(0).alias("step")).unionAll(edges.select("id", "kind", "step"))


# --- inheritance ---

CLASSES = "chosen AS (SELECT DISTINCT concat('Class:c', CAST(child AS STRING)) AS root FROM fx_ext)"


def classes(fx):
    return fx.fx_ext.select(F.concat(F.lit("Class:c"), F.col("child").cast("string")).alias("root")).distinct()


@query("SELECT root, node, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY root, node", "fx_extends",
       extra=f"{CLASSES}, up AS (SELECT root, root AS node, 0 AS depth FROM chosen UNION SELECT root, target_id, depth + 1 FROM up JOIN fx_extends ON source_id = node)")
def ancestors(fx):
    return heritage.ancestors(fx.fx_extends, classes(fx))


@query("SELECT root, node, min(depth) AS depth FROM down WHERE depth > 0 GROUP BY root, node", "fx_extends",
       extra=f"{CLASSES}, down AS (SELECT root, root AS node, 0 AS depth FROM chosen UNION SELECT root, source_id, depth + 1 FROM down JOIN fx_extends ON target_id = node)")
def descendants(fx):
    return heritage.descendants(fx.fx_extends, classes(fx))


CLOSURE = "up AS (SELECT DISTINCT source_id AS root, source_id AS node, 0 AS depth FROM fx_extends UNION SELECT root, target_id, depth + 1 FROM up JOIN fx_extends ON source_id = node), above AS (SELECT root, node, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY root, node)"
DUOS = "duos AS (SELECT concat('Class:c', CAST(p_partkey AS STRING)) AS a, concat('Class:c', CAST(p_partkey * 2 + 1 AS STRING)) AS b FROM part WHERE p_partkey * 2 + 1 < (SELECT count(*) FROM part))"


def duos(fx):
    n = fx.table("part").count()
    name = lambda c: F.concat(F.lit("Class:c"), c.cast("string"))
    k = F.col("p_partkey")
    return fx.table("part").where(k * 2 + 1 < n).select(name(k).alias("a"), name(k * 2 + 1).alias("b"))


@query("SELECT a, b, (SELECT arg_min(y.node, (y.depth, y.node)) FROM above y WHERE y.root = b AND y.node IN (SELECT node FROM above WHERE root = a)) AS ancestor FROM duos", "fx_extends", extra=f"{CLOSURE}, {DUOS}")
def common_ancestor(fx):
    return heritage.common_ancestors(fx.fx_extends, duos(fx))


@query("SELECT b AS child, a AS parent, EXISTS (SELECT 1 FROM above WHERE root = b AND node = a) AS is_subclass FROM duos", "fx_extends", extra=f"{CLOSURE}, {DUOS}")
def subclass_of(fx):
    return heritage.subclasses(fx.fx_extends, duos(fx).select(F.col("b").alias("child"), F.col("a").alias("parent")))


@query("SELECT kind, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM fx_extends GROUP BY kind", "fx_extends")
def heritage_stats(fx):
    return heritage.heritage_stats(fx.fx_extends)


@query("SELECT id, name, kind FROM (SELECT id, name, 'class' AS kind FROM fx_nodes WHERE kind = 'Class' UNION ALL SELECT DISTINCT i, '', 'class' FROM (SELECT source_id AS i FROM fx_extends UNION SELECT target_id FROM fx_extends) AS e) AS u", "fx_nodes", "fx_extends")
def inheritance_nodes(fx):
    return heritage.inheritance_nodes(fx.fx_nodes, fx.fx_extends)


CHAIN = "chain AS (SELECT concat('K', CAST(p_partkey AS STRING)) AS source_id, concat('K', CAST(p_partkey - 1 AS STRING)) AS target_id, p_partkey AS n FROM part WHERE p_partkey % 8 <> 0)"


@query("SELECT id, string_agg(concat('K', CAST(n - j AS STRING)), ' ' ORDER BY j) AS linearization FROM (SELECT source_id AS id, n, unnest(generate_series(0, n % 8)) AS j FROM chain) AS u GROUP BY id", extra=CHAIN)
def mro_chains(fx):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("K"), c.cast("string"))
    edges = fx.table("part").where(k % 8 != 0).select(name(k).alias("source_id"), name(k - 1).alias("target_id"), F.lit("EXTENDS").alias("kind"), k.alias("ord"))
    return heritage.linearisations(edges, edges.select(F.col("source_id").alias("id"))).select("id", F.array_join("linearization", " ").alias("linearization"))


#: C3, a step of every merge a round, for each class as soon as its parents' are done; where a merge finds no head, post-order.
MRO = """ups AS (SELECT source_id AS id, list(target_id ORDER BY ord, target_id) AS ps FROM fx_extends GROUP BY source_id),
 ids AS (SELECT source_id AS id FROM fx_extends UNION SELECT target_id FROM fx_extends),
 mro(id, path, lists, state) USING KEY (id) AS (SELECT id, [id], CAST([] AS VARCHAR[][]), CASE WHEN ps IS NULL THEN 'done' ELSE 'waits' END FROM ids LEFT JOIN ups USING (id) UNION
   SELECT n.id, n.path, n.lists, n.state FROM (
     SELECT r.id, r.path, list_append(list(p.path ORDER BY list_position(u.ps, p.id)), any_value(u.ps)) AS lists, CASE WHEN bool_or(p.state = 'odd') THEN 'odd' ELSE 'merges' END AS state
     FROM recurring.mro r JOIN ups u USING (id) JOIN recurring.mro p ON list_contains(u.ps, p.id) WHERE r.state = 'waits' GROUP BY r.id, r.path HAVING bool_and(p.state IN ('done', 'odd'))
     UNION ALL SELECT id, CASE WHEN head IS NULL THEN path ELSE list_append(path, head) END, list_filter(list_transform(lists, lambda x: CASE WHEN x[1] = head THEN x[2:] ELSE x END), lambda x: len(x) > 0), CASE WHEN len(lists) = 0 THEN 'done' WHEN head IS NULL THEN 'odd' ELSE 'merges' END
     FROM (SELECT id, path, lists, list_filter(list_transform(lists, lambda x: x[1]), lambda h: NOT list_contains(flatten(list_transform(lists, lambda x: x[2:])), h))[1] AS head FROM recurring.mro WHERE state = 'merges') AS m) AS n WHERE EXISTS (SELECT 1 FROM mro)),
 dfs(id, stack, met, path) AS (SELECT id, [id], [id], CAST([] AS VARCHAR[]) FROM mro WHERE state = 'odd' UNION ALL
   SELECT id, CASE WHEN next IS NULL THEN stack[:-2] ELSE list_append(stack, next) END, CASE WHEN next IS NULL THEN met ELSE list_append(met, next) END, CASE WHEN next IS NULL THEN list_append(path, stack[-1]) ELSE path END
   FROM (SELECT d.*, list_filter(u.ps, lambda x: NOT list_contains(d.met, x))[1] AS next FROM dfs d LEFT JOIN ups u ON u.id = d.stack[-1] WHERE len(d.stack) > 0) AS n),
 linear AS (SELECT id, path, true AS consistent FROM mro WHERE state = 'done' UNION ALL SELECT id, path, false FROM dfs WHERE len(stack) = 0)"""


@query("SELECT id, array_to_string(path, ' ') AS linearization, consistent FROM linear WHERE id IN (SELECT id FROM ups)", "fx_extends", extra=MRO)
def mro_linearization(fx):
    told = heritage.linearisations(fx.fx_extends, fx.fx_extends.select(F.col("source_id").alias("id")))
    return told.select("id", F.array_join("linearization", " ").alias("linearization"), "consistent")


@query(
    """SELECT id, method, string_agg(owner, ' ' ORDER BY pos) AS sources, arg_min(owner, pos) AS resolved_to FROM (SELECT id, generate_subscripts(path, 1) AS pos, unnest(path) AS owner FROM linear WHERE id IN (SELECT id FROM ups)) AS l
       JOIN (SELECT concat('Class:c', CAST(p_partkey AS STRING)) AS owner, concat('m', CAST(p_partkey % 40 AS STRING)) AS method FROM part) AS m USING (owner) GROUP BY id, method HAVING count(*) > 1""",
    "fx_extends", extra=MRO,
)
def method_conflicts(fx):
    linear = heritage.linearisations(fx.fx_extends, classes(fx).withColumnRenamed("root", "id"))
    methods = fx.table("part").select(F.concat(F.lit("Class:c"), F.col("p_partkey").cast("string")).alias("owner"), F.concat(F.lit("m"), (F.col("p_partkey") % 40).cast("string")).alias("method"))
    return heritage.method_conflicts(linear, methods).select("id", "method", F.array_join("sources", " ").alias("sources"), "resolved_to")


@query(
    """SELECT s.name, s.file_path, arg_min(t.id, (CASE WHEN t.file_path = s.file_path THEN 0 WHEN i.to_file IS NOT NULL THEN 1 ELSE 2 END, t.ord)) AS id FROM (SELECT DISTINCT called_name AS name, file_path FROM fx_sites) s
       LEFT JOIN fx_nodes t ON t.name = s.name LEFT JOIN fx_imports i ON i.from_file = s.file_path AND i.to_file = t.file_path GROUP BY s.name, s.file_path""",
    "fx_sites", "fx_imports",
)
def symbol_lookup(fx):
    return heritage.find_symbols(fx.asked(), fx.fx_nodes, fx.imports())
