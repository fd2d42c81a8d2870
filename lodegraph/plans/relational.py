"""Queries of the relational layer: filters, joins, changes, aggregates, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import graph as G
from ..functions import paths
from ..functions.text import clean_id, half_up
from ..operators import calls, process
from ..sources import ignore, language
from .fixtures import Fixtures
from .register import query


def graph_of(fx: Fixtures) -> G.Graph:
    return G.Graph(fx.fx_nodes, fx.fx_edges)


def roots(fx: Fixtures) -> DataFrame:
    """The stated start nodes of the traversals: those whose number is divisible by 100."""
    return fx.fx_nodes.where(F.col("ord") % 100 == 0).select(F.col("id").alias("root"))


ROOTS = "fx_roots AS (SELECT id AS root FROM fx_nodes WHERE ord % 100 = 0)"


@query("SELECT kind, count(*) AS n FROM fx_nodes GROUP BY kind", "fx_nodes")
def nodes_by_kind(fx):
    return fx.fx_nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*) AS n, round(sum(confidence), 4) AS total FROM fx_edges GROUP BY kind", "fx_edges")
def edge_kind_histogram(fx):
    return fx.fx_edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("SELECT kind, language, count(*) AS n FROM fx_nodes GROUP BY ROLLUP (kind, language)", "fx_nodes")
def kind_language_rollup(fx):
    return fx.fx_nodes.rollup("kind", "language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT (SELECT count(*) FROM fx_nodes) AS node_count, (SELECT count(*) FROM fx_edges) AS edge_count, (SELECT count(DISTINCT language) FROM fx_nodes) AS n_languages, (SELECT count(DISTINCT kind) FROM fx_edges) AS n_relations",
    "fx_edges",
)
def graph_metadata(fx):
    told = graph_of(fx).metadata()
    return told.select("node_count", "edge_count", F.size("languages").cast("long").alias("n_languages"), F.size("relation_kinds").cast("long").alias("n_relations"))


@query(
    "SELECT id, name FROM fx_nodes WHERE kind IN ('Function', 'Method') AND regexp_matches(file_path, 'brand[12]') AND regexp_matches(name, '[02468]$') AND is_exported AND language = 'python'",
    "fx_nodes",
)
def find_nodes_filter(fx):
    return graph_of(fx).find_nodes(["Function", "Method"], "brand[12]", "[02468]$", True, "python").select("id", "name")


@query("SELECT id, confidence FROM fx_edges WHERE kind IN ('CALLS', 'MEMBER_OF') AND confidence >= 0.8", "fx_edges")
def find_edges_min_conf(fx):
    return graph_of(fx).find_edges(["CALLS", "MEMBER_OF"], min_confidence=0.8).select("id", "confidence")


@query("SELECT id FROM fx_nodes WHERE kind = 'Constructor' AND is_exported IS NOT DISTINCT FROM false AND language = 'go'", "fx_nodes")
def fluent_query(fx):
    return G.NodeQuery(graph_of(fx)).where_kind("Method").where_kind("Constructor").where_exported(False).where_language("go").find_nodes().select("id")


@query("SELECT id, kind, name FROM fx_nodes WHERE kind = 'Function' AND name = (SELECT min(name) FROM fx_nodes WHERE kind = 'Function')", "fx_nodes")
def exact_lookup(fx):
    nodes = fx.fx_nodes
    first = nodes.where("kind = 'Function'").agg(F.min("name").alias("name"))
    return nodes.where("kind = 'Function'").join(first, "name", "left_semi").select("id", "kind", "name")


@query("SELECT id FROM fx_nodes WHERE lower(name) LIKE '%ing%' AND coalesce(is_exported, false) = false AND file_path LIKE '%f3.%'", "fx_nodes")
def search_fuzzy(fx):
    return G.search(fx.fx_nodes, name="ING", file="f3.", exported=False).select("id")


@query("SELECT id FROM fx_nodes WHERE regexp_matches(file_path, '/f[0-2]\\.(ts|go)$') AND kind = 'Class' AND language = 'go'", "fx_nodes")
def search_by_pattern(fx):
    return G.search(fx.fx_nodes, kind="Class", file=r"/f[0-2]\.(ts|go)$", pattern=True, language="go").select("id")


@query("SELECT id FROM fx_nodes WHERE false", "fx_nodes")
def search_without_criteria(fx):
    return G.search(fx.fx_nodes).select("id")


@query(
    "SELECT id, kind, name, file_path AS file, start_line AS line, is_exported AS exported FROM fx_nodes WHERE (lower(name) LIKE '%brand12%' OR lower(file_path) LIKE '%brand12%') AND kind = 'Function' ORDER BY ord LIMIT 20",
    "fx_nodes",
)
def tool_query_topn(fx):
    return G.top_matches(fx.fx_nodes, "Brand12", kind="Function")


@query(
    """SELECT symbol, coalesce(n.id, f.id) AS id FROM asked LEFT JOIN fx_nodes n ON n.id = symbol AND symbol LIKE '%:%'
       LEFT JOIN (SELECT name, arg_min(id, ord) AS id FROM fx_nodes GROUP BY name) f ON f.name = symbol AND symbol NOT LIKE '%:%'""",
    "fx_nodes",
    extra="asked AS (SELECT CASE WHEN ord % 2 = 0 THEN id WHEN ord % 3 = 0 THEN concat(name, '?') ELSE name END AS symbol FROM fx_nodes)",
)
def resolve_symbols(fx):
    asked = fx.fx_nodes.select(F.when(F.col("ord") % 2 == 0, F.col("id")).when(F.col("ord") % 3 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("symbol"))
    names = asked.withColumn("_n", F.monotonically_increasing_id())
    told = G.resolve_symbols(fx.fx_nodes, names.select("symbol").distinct())
    return names.join(told, "symbol").select("symbol", "id")


@query(
    """SELECT path, regexp_matches(path, '\\.test\\.|\\.spec\\.|__tests__|__mocks__|/test/|/tests/|_test\\.py$|_test\\.go$|_spec\\.rb$|Test\\.java$|Tests\\.cs$') AS is_test FROM variants""",
    "fx_nodes",
    extra="""variants AS (SELECT CASE WHEN ord % 6 = 0 THEN replace(file_path, '.ts', '.test.ts') WHEN ord % 6 = 1 THEN replace(file_path, '.py', '_test.py')
             WHEN ord % 6 = 2 THEN replace(file_path, 'src/', 'src/tests/') WHEN ord % 6 = 3 THEN replace(file_path, 'src/', '__mocks__') ELSE file_path END AS path FROM fx_nodes)""",
)
def test_file_paths(fx):
    o, p = F.col("ord") % 6, F.col("file_path")
    swap = lambda a, b: F.replace(p, F.lit(a), F.lit(b))
    path = F.when(o == 0, swap(".ts", ".test.ts")).when(o == 1, swap(".py", "_test.py")).when(o == 2, swap("src/", "src/tests/")).when(o == 3, swap("src/", "__mocks__")).otherwise(p)
    return fx.fx_nodes.select(path.alias("path")).select("path", process.is_test_file(F.col("path")).alias("is_test"))


@query("SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM (SELECT DISTINCT file_path FROM fx_nodes) AS u WHERE file_path LIKE '%.ts' OR file_path LIKE '%.py' GROUP BY 1", "fx_nodes")
def files_by_folder(fx):
    files = fx.fx_nodes.select("file_path").distinct().where(F.col("file_path").rlike(r"\.(ts|py)$"))
    return files.groupBy(paths.parent(F.col("file_path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


BOTH = "ways AS (SELECT source_id AS a, target_id AS b FROM fx_edges UNION ALL SELECT target_id, source_id FROM fx_edges)"


@query("SELECT root, n.id, n.kind, n.name FROM fx_roots JOIN ways ON a = root JOIN fx_nodes n ON n.id = b", "fx_edges", extra=f"{ROOTS}, {BOTH}")
def neighbors_bag(fx):
    return graph_of(fx).neighbors(roots(fx)).select("root", "id", "kind", "name")


@query("SELECT DISTINCT root, n.id FROM fx_roots JOIN ways ON a = root JOIN fx_nodes n ON n.id = b WHERE a <> b", "fx_edges", extra=f"{ROOTS}, ways AS (SELECT source_id AS a, target_id AS b FROM fx_calls UNION ALL SELECT target_id, source_id FROM fx_calls)")
def related_distinct(fx):
    return graph_of(fx).related(roots(fx), "CALLS")


@query("SELECT id, (SELECT count(*) FROM fx_calls WHERE source_id = n.id) AS fan_out, (SELECT count(*) FROM fx_calls WHERE target_id = n.id) AS fan_in FROM fx_nodes n", "fx_calls")
def fan_in_out(fx):
    return G.fan(fx.fx_nodes.select("id"), fx.fx_calls)


@query("SELECT 'node' AS entity, id FROM fx_nodes WHERE ord % 9 <> 0 UNION ALL SELECT 'edge', id FROM fx_calls WHERE source_id NOT IN (SELECT id FROM fx_nodes WHERE ord % 9 = 0) AND target_id NOT IN (SELECT id FROM fx_nodes WHERE ord % 9 = 0)", "fx_calls")
def cascade_remove(fx):
    left = G.Graph(fx.fx_nodes, fx.fx_calls).remove_nodes(fx.fx_nodes.where("ord % 9 = 0"))
    return left.nodes.select(F.lit("node").alias("entity"), "id").unionAll(left.edges.select(F.lit("edge").alias("entity"), "id"))


@query("SELECT id, kind FROM fx_edges WHERE source_id NOT IN (SELECT id FROM fx_nodes) OR target_id NOT IN (SELECT id FROM fx_nodes)", "fx_edges")
def dangling_edges(fx):
    return graph_of(fx).dangling().select("id", "kind")


@query(
    """SELECT 'added' AS change, 'node' AS entity, id FROM fx_nodes WHERE ord % 10 = 0 AND ord % 10 <> 1 UNION ALL SELECT 'removed', 'node', id FROM fx_nodes WHERE ord % 10 = 1
       UNION ALL SELECT 'added', 'edge', id FROM fx_calls WHERE ord % 10 = 0 UNION ALL SELECT 'removed', 'edge', id FROM fx_calls WHERE ord % 10 = 1""",
    "fx_calls",
)
def snapshot_diff(fx):
    before = G.Graph(fx.fx_nodes.where("ord % 10 <> 0"), fx.fx_calls.where("ord % 10 <> 0"))
    return G.Graph(fx.fx_nodes.where("ord % 10 <> 1"), fx.fx_calls.where("ord % 10 <> 1")).diff(before)


@query(
    """SELECT entity, id, mark FROM (
         SELECT 'node' AS entity, id, CASE WHEN ord % 13 = 5 THEN 'new' ELSE name END AS mark FROM fx_nodes WHERE ord % 7 <> 3 OR ord % 13 = 5
         UNION ALL SELECT 'edge', id, kind FROM fx_calls WHERE ord % 17 <> 4 AND (ord % 2 = 0 AND source_id NOT IN (SELECT id FROM fx_nodes WHERE ord % 7 = 3) AND target_id NOT IN (SELECT id FROM fx_nodes WHERE ord % 7 = 3) OR ord % 2 = 1)) AS u""",
    "fx_calls",
)
def apply_diff(fx):
    nodes, edges = fx.fx_nodes, fx.fx_calls
    made = G.Graph(nodes.where("ord % 3 <> 0"), edges.where("ord % 2 = 0")).apply(
        added_nodes=nodes, removed_nodes=nodes.where("ord % 7 = 3"), updated_nodes=nodes.where("ord % 13 = 5").withColumn("name", F.lit("new")),
        added_edges=edges.where("ord % 2 = 1"), removed_edges=edges.where("ord % 17 = 4"),
    )
    return made.nodes.select(F.lit("node").alias("entity"), "id", F.col("name").alias("mark")).unionAll(made.edges.select(F.lit("edge").alias("entity"), "id", F.col("kind").alias("mark")))


@query(
    """SELECT id FROM fx_nodes WHERE kind = 'Function' AND id IN (SELECT source_id FROM fx_calls WHERE confidence = 1.0) AND id NOT IN (SELECT target_id FROM fx_calls WHERE confidence = 1.0)""",
    "fx_calls",
)
def set_operations(fx):
    functions, calls_ = fx.fx_nodes.where("kind = 'Function'").select("id"), fx.fx_calls.where("confidence = 1.0")
    return functions.intersect(calls_.select(F.col("source_id").alias("id"))).exceptAll(functions.intersect(calls_.select(F.col("target_id").alias("id"))))


@query("SELECT language, string_agg(id, ',' ORDER BY ord) AS ids FROM fx_nodes GROUP BY language", "fx_nodes")
def inverted_index(fx):
    return G.inverted_index(fx.fx_nodes, "language").select("language", F.array_join("ids", ",").alias("ids"))


TIERS = """found AS (SELECT s.site, s.file_path, t.id AS target_id, t.name AS target_name, CASE WHEN s.file_path = t.file_path THEN 0 WHEN i.to_file IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM fx_sites s JOIN fx_nodes t ON t.name = s.called_name AND t.kind <> 'Class' LEFT JOIN fx_imports i ON i.from_file = s.file_path AND i.to_file = t.file_path)"""


@query("SELECT site, target_id, tier FROM found", "fx_sites", "fx_imports", extra=TIERS)
def call_candidates(fx):
    return calls.candidates(fx.fx_sites, fx.fx_nodes, fx.imports()).select("site", "target_id", F.col("tier").cast("int").alias("tier"))


RESOLVED = (
    TIERS
    + """, counted AS (SELECT s.site, s.source_id, s.call_form, s.receiver, s.receiver_type, count(f.target_id) AS n_candidates, min(f.target_id) AS only_id,
    count(f.target_id) FILTER (WHERE s.receiver_type IS NOT NULL AND (contains(f.target_id, s.receiver_type) OR f.target_name = s.receiver_type)) AS n_fit,
    min(f.target_id) FILTER (WHERE s.receiver_type IS NOT NULL AND (contains(f.target_id, s.receiver_type) OR f.target_name = s.receiver_type)) AS fit
  FROM fx_sites s LEFT JOIN found f ON f.site = s.site GROUP BY ALL),
 resolved AS (SELECT *, CASE WHEN n_fit = 1 THEN fit WHEN n_candidates = 1 THEN only_id END AS target_id, CASE WHEN n_fit = 1 THEN 'receiver-resolved' WHEN n_candidates = 1 THEN 'exact-match' END AS method FROM counted),
 scored AS (SELECT *, (CASE call_form WHEN 'constructor' THEN 0.95::DOUBLE WHEN 'member' THEN 0.9::DOUBLE WHEN 'static' THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END)
   * (CASE WHEN receiver_type IS NULL AND receiver IS NOT NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN method = 'exact-match' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS exact FROM resolved)"""
)


@query(
    "SELECT site, target_id, method, n_candidates, CASE WHEN target_id IS NULL THEN CASE WHEN n_candidates > 1 THEN 'multiple candidates' ELSE 'no candidates' END END AS failure FROM resolved",
    "fx_sites", "fx_imports", extra=RESOLVED,
)
def call_resolution(fx):
    return calls.resolve(fx.fx_sites, fx.fx_nodes, fx.fx_imports).select("site", "target_id", "method", "n_candidates", "failure")


@query("SELECT site, floor(exact * 100.0 + 0.5) / 100.0 AS score, CASE WHEN exact >= 0.8 THEN 'high' WHEN exact >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM scored WHERE target_id IS NOT NULL", "fx_sites", "fx_imports", extra=RESOLVED)
def call_confidence(fx):
    found = calls.resolve(fx.fx_sites, fx.fx_nodes, fx.fx_imports).where("target_id is not null")
    told = calls.confidence(F.col("call_form"), F.col("receiver_type"), F.col("receiver"), F.col("method"), F.lit(False))
    return found.select("site", told["score"].alias("score"), told["level"].alias("level"))


@query(
    """SELECT count(*) AS total, count(target_id) AS resolved, count(*) - count(target_id) AS unresolved,
       round(coalesce(avg(floor(exact * 100.0 + 0.5) / 100.0) FILTER (WHERE target_id IS NOT NULL), 0), 6) AS average_confidence FROM scored""",
    "fx_sites", "fx_imports", extra=RESOLVED,
)
def call_resolution_stats(fx):
    told = calls.call_stats(calls.resolve(fx.fx_sites, fx.fx_nodes, fx.fx_imports))
    return told.withColumn("average_confidence", F.round("average_confidence", 6))


@query("SELECT id FROM fx_calls WHERE confidence >= 0.8", "fx_calls")
def call_threshold(fx):
    return fx.fx_calls.where(F.col("confidence") >= calls.HIGH).select("id")


@query(
    """SELECT site, coalesce(e.t, c.name, CASE WHEN receiver IN ('this', 'self', '$this') THEN enclosing_class END) AS receiver_type FROM sites
       LEFT JOIN env e ON e.file_path = sites.file_path AND e.v = receiver LEFT JOIN (SELECT DISTINCT name FROM fx_nodes WHERE kind = 'Class') c ON c.name = receiver""",
    "fx_sites",
    extra="""sites AS (SELECT site, file_path, CASE WHEN line % 4 = 0 THEN 'this' WHEN line % 4 = 1 THEN 'super' ELSE called_name END AS receiver, concat('C', CAST(line AS STRING)) AS enclosing_class FROM fx_sites),
      env AS (SELECT file_path, name AS v, min(concat('T', CAST(ord AS STRING))) AS t FROM fx_nodes GROUP BY file_path, name)""",
)
def receiver_types(fx):
    name = F.when(F.col("line") % 4 == 0, "this").when(F.col("line") % 4 == 1, "super").otherwise(F.col("called_name"))
    sites = fx.fx_sites.select("site", "file_path", name.alias("receiver"), F.concat(F.lit("C"), F.col("line").cast("string")).alias("enclosing_class"))
    env = fx.fx_nodes.select("file_path", F.col("name").alias("var"), F.concat(F.lit("T"), F.col("ord").cast("string")).alias("type"))
    return calls.receiver_types(sites, env, fx.fx_nodes).select("site", "receiver_type")


@query(
    """SELECT n.file_path, n.start_line AS line, (SELECT arg_min(s.id, (s.end_line - s.start_line, s.ord)) FROM fx_nodes s WHERE s.file_path = n.file_path AND s.kind <> 'Class'
        AND s.start_line <= n.start_line AND n.start_line <= s.end_line) AS enclosing_id FROM (SELECT DISTINCT file_path, start_line FROM fx_nodes WHERE kind = 'Class') n""",
    "fx_nodes",
)
def enclosing_definition(fx):
    points = fx.fx_nodes.where("kind = 'Class'").select("file_path", F.col("start_line").alias("line")).distinct()
    return calls.enclosing(points, fx.fx_nodes.where("kind <> 'Class'"))


@query(
    "SELECT s.site, arg_min(t.id, t.ord) AS target_id FROM fx_sites s JOIN fx_nodes t ON t.file_path = s.file_path AND t.name = s.called_name AND t.start_line <= s.line GROUP BY s.site",
    "fx_sites",
)
def earlier_definitions(fx):
    return calls.earlier_definitions(fx.fx_sites, fx.fx_nodes)


@query("SELECT path, lang FROM (SELECT path, CASE WHEN e IN ('ts','tsx','mts','cts') THEN 'typescript' WHEN e IN ('js','jsx','mjs','cjs') THEN 'javascript' WHEN e IN ('py','pyi','pyx') THEN 'python' WHEN e = 'go' THEN 'go' WHEN e = 'rs' THEN 'rust' WHEN e IN ('cpp','cc','cxx','hpp','hxx','hh','h') THEN 'cpp' WHEN b = 'Dockerfile' THEN 'javascript' WHEN b IN ('go.mod') THEN 'go' END AS lang FROM p) AS u",
       "fx_nodes", extra="""v AS (SELECT CASE WHEN ord % 8 = 0 THEN concat(file_path, 'x') WHEN ord % 8 = 1 THEN replace(file_path, '.py', '.rs') WHEN ord % 8 = 2 THEN concat(file_path, '/Dockerfile')
        WHEN ord % 8 = 3 THEN concat(file_path, '/go.mod') WHEN ord % 8 = 4 THEN replace(file_path, '.go', '.HPP') ELSE file_path END AS path FROM fx_nodes),
       p AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS b, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS e FROM v)""")  # fmt: skip
def language_by_path(fx):
    o, p = F.col("ord") % 8, F.col("file_path")
    swap = lambda a, b: F.replace(p, F.lit(a), F.lit(b))
    path = F.when(o == 0, F.concat(p, F.lit("x"))).when(o == 1, swap(".py", ".rs")).when(o == 2, F.concat(p, F.lit("/Dockerfile"))).when(o == 3, F.concat(p, F.lit("/go.mod"))).when(o == 4, swap(".go", ".HPP")).otherwise(p)
    return fx.fx_nodes.select(path.alias("path")).select("path", language.detect(F.col("path"))["language"].alias("lang"))


def _content_sql() -> str:
    rules = ", ".join("({}, '{}', '{}', {})".format(i, lang, pattern.replace("'", "''"), weight) for i, (lang, pattern, weight) in enumerate(language.CONTENT_RULES))
    return f"""SELECT doc_id, arg_max(lang, (score, -place)) AS lang FROM (
      SELECT doc_id, place, lang, round(count(*) FILTER (WHERE regexp_matches(line, pattern)) * CAST(weight AS DOUBLE), 6) AS score
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))[1:50]) AS line FROM made) AS l, (VALUES {rules}) AS r(place, lang, pattern, weight) GROUP BY doc_id, place, lang, weight) AS s
      WHERE score >= 0.5 GROUP BY doc_id"""


MADE = """made AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat('def f', CAST(doc_id AS STRING), '(x):', chr(10), 'import os', chr(10), text) WHEN doc_id % 7 = 1 THEN concat('package main', chr(10), 'func f()', chr(10), text)
  WHEN doc_id % 7 = 2 THEN concat('use std::io;', chr(10), 'fn main()', chr(10), text) WHEN doc_id % 7 = 3 THEN concat('<?php', chr(10), text) ELSE text END AS text FROM documents)"""


@query(_content_sql(), extra=MADE)
def content_language_rules(fx):
    d, t, nl = F.col("doc_id") % 7, F.col("text"), F.lit("\n")
    made = F.when(d == 0, F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(x):"), nl, F.lit("import os"), nl, t)).when(d == 1, F.concat(F.lit("package main"), nl, F.lit("func f()"), nl, t))
    made = made.when(d == 2, F.concat(F.lit("use std::io;"), nl, F.lit("fn main()"), nl, t)).when(d == 3, F.concat(F.lit("<?php"), nl, t)).otherwise(t)
    found = fx.table("documents").select("doc_id", language.by_content(made).alias("lang"))
    return found.where("lang is not null")


@query(
    """SELECT id, CASE WHEN language = 'typescript' THEN regexp_matches(line, '^\\s*export\\b') WHEN language = 'python' THEN NOT starts_with(n, '_') ELSE substr(n, 1, 1) = upper(substr(n, 1, 1)) END AS exported FROM v""",
    "fx_nodes",
    extra="""v AS (SELECT id, language, CASE WHEN ord % 5 = 0 THEN concat('_', name) WHEN ord % 5 = 1 THEN concat('Do', name) ELSE name END AS n, CASE WHEN ord % 4 = 0 THEN 'export function f()' ELSE 'function f()' END AS line FROM fx_nodes)""",
)
def export_flags(fx):
    name = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("_"), "name")).when(F.col("ord") % 5 == 1, F.concat(F.lit("Do"), "name")).otherwise(F.col("name"))
    line = F.when(F.col("ord") % 4 == 0, "export function f()").otherwise("function f()")
    return fx.fx_nodes.select("id", language.is_exported(line, name, F.col("language")).alias("exported"))


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_\\-:./]', '_', 'g'), '_+', '_', 'g'), 1, 200) AS id FROM documents")
def sanitize_id(fx):
    return fx.table("documents").select("doc_id", clean_id(F.col("text")).alias("id"))


FORMS = """v AS (SELECT id, ord, CASE WHEN ord % 6 = 0 THEN concat('new ', name, '()') WHEN ord % 6 = 1 THEN concat('obj.', name, '(1, 2)') WHEN ord % 6 = 2 THEN concat('Cls::', name, '()') WHEN ord % 6 = 3 THEN concat('$this->', name, ' (x)')
   WHEN ord % 6 = 4 THEN concat('self::', name, '()') ELSE concat(name, '("x")') END AS t FROM (SELECT id, ord, replace(name, '#', '') AS name FROM fx_nodes) AS u)"""


def _forms(fx):
    o, n = F.col("ord") % 6, F.replace("name", F.lit("#"), F.lit(""))
    put = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    text = F.when(o == 0, put("new ", "()")).when(o == 1, put("obj.", "(1, 2)")).when(o == 2, put("Cls::", "()")).when(o == 3, put("$this->", " (x)")).when(o == 4, put("self::", "()")).otherwise(put("", '("x")'))
    return fx.fx_nodes.select("id", text.alias("t"))


@query(
    """SELECT id, CASE WHEN starts_with(trim(t), 'new ') THEN 'constructor' WHEN regexp_matches(t, '::\\w+\\s*\\(') THEN 'static' WHEN regexp_matches(t, '(\\.|->)\\w+\\s*\\(') THEN 'member' ELSE 'free' END AS form,
       coalesce(nullif(regexp_extract(t, '([a-zA-Z_][a-zA-Z0-9_]*)\\.[a-zA-Z_][a-zA-Z0-9_]*\\s*\\(', 1), ''), nullif(regexp_extract(t, '([a-zA-Z_][a-zA-Z0-9_]*)->[a-zA-Z_][a-zA-Z0-9_]*\\s*\\(', 1), ''),
         CASE WHEN regexp_matches(t, 'self::[a-zA-Z_][a-zA-Z0-9_]*\\s*\\(') THEN 'self' END) AS receiver,
       CAST(len(regexp_extract_all(substr(t, 1, 8), '\\.|->')) AS INT) AS depth FROM v""",
    "fx_nodes", extra=FORMS,
)
def call_forms(fx):
    t = F.col("t")
    return _forms(fx).select("id", calls.call_form(t).alias("form"), calls.receiver(t).alias("receiver"), calls.chain_depth(t, F.lit(8)).alias("depth"))


@query(
    """SELECT doc_id, instr(substr(text, 1, 8192), chr(0)) > 0 OR (length(text) > 0 AND CAST(length(regexp_replace(substr(text, 1, 8192), '[\\t-\\r -~]', '', 'g')) AS DOUBLE) / length(substr(text, 1, 8192)) > 0.1) AS by_text,
       length(text) > 0 AND CAST(len(regexp_extract_all(hex(encode(text))[1:16384], '..')) - len(list_filter(regexp_extract_all(hex(encode(text))[1:16384], '..'), lambda x: regexp_matches(x, '^(09|0[A-D]|[2-6][0-9A-F]|7[0-9A-E])$'))) AS DOUBLE)
         / len(regexp_extract_all(hex(encode(text))[1:16384], '..')) > 0.1 AS by_bytes FROM documents"""
)
def binary_sniff(fx):
    return fx.table("documents").select("doc_id", ignore.is_binary_text(F.col("text")).alias("by_text"), ignore.is_binary(F.col("text").cast("binary")).alias("by_bytes"))


@query(
    """SELECT path, regexp_matches(path, '(^|/)(dist|build|node_modules)(/|$)') OR regexp_matches(path, '(^|/)[^/]*\\.png(/|$)') AS ignored FROM v""",
    "fx_nodes",
    extra="""v AS (SELECT CASE WHEN ord % 5 = 0 THEN replace(file_path, 'src/', 'dist/') WHEN ord % 5 = 1 THEN replace(file_path, 'brand', 'node_modules/brand') WHEN ord % 5 = 2 THEN concat(file_path, '.png') ELSE file_path END AS path FROM fx_nodes)""",
)
def ignore_filter(fx):
    o, p = F.col("ord") % 5, F.col("file_path")
    swap = lambda a, b: F.replace(p, F.lit(a), F.lit(b))
    path = F.when(o == 0, swap("src/", "dist/")).when(o == 1, swap("brand", "node_modules/brand")).when(o == 2, F.concat(p, F.lit(".png"))).otherwise(p)
    return fx.fx_nodes.select(path.alias("path")).select("path", ignore.IgnorePatterns().ignores(F.col("path")).alias("ignored"))


@query("SELECT event_type, count(*) AS n, floor(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) * 10.0 + 0.5) / 10.0 AS mean_k FROM events GROUP BY event_type")
def event_props(fx):
    k = F.get_json_object("props", "$.k").cast("double")
    return fx.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(k), 1).alias("mean_k"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events")
def step_numbering(fx):
    """A user's events as the trace of a process, its steps numbered."""
    each = fx.table("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id")))["event_id"].alias("trace"))
    steps = process.process_steps(each.withColumnRenamed("user_id", "id"))
    return steps.select(F.col("id").alias("user_id"), F.col("node_id").alias("event_id"), F.col("step").cast("long").alias("step"))
