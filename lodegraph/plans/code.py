"""Queries over paths, imports, source text, ranking, and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import extract, imports, search, types
from ..plans import ingest
from ..sources import walk
from ..streaming import incremental
from .register import query
from .relational import graph_of

SPLIT = "pieces AS (SELECT path, string_split(path, '/') AS s FROM fx_paths), pre AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS prefix, i = len(s) AS is_file, i FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM pieces) AS u WHERE array_to_string(s[1:i], '/') <> ''), best AS (SELECT prefix, max(is_file) AS is_file, min(i) AS i FROM pre GROUP BY prefix)"


def _paths(fx):
    return fx.fx_paths


@query("SELECT CASE WHEN is_file THEN concat('File:', prefix) ELSE concat('Folder:', prefix) END AS id, i - 1 AS depth FROM best", "fx_paths", extra=SPLIT)
def structure_nodes(fx):
    nodes, _ = extract.structure(_paths(fx))
    return nodes.select("id", F.col("ord").alias("depth"))


@query("SELECT concat('Folder:', regexp_extract(prefix, '^(.*)/[^/]*$', 1)) AS source_id, CASE WHEN is_file THEN concat('File:', prefix) ELSE concat('Folder:', prefix) END AS target_id FROM best WHERE i > 1", "fx_paths", extra=SPLIT)
def structure_edges(fx):
    _, edges = extract.structure(_paths(fx))
    return edges.select("source_id", "target_id")


SUFFIXES = "suf AS (SELECT arg_min(path, ord) AS path, suffix FROM (SELECT path, ord, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM (SELECT path, ord, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM fx_paths) AS u) AS v GROUP BY suffix)"


@query("SELECT suffix AS key, path FROM suf", "fx_paths", extra=SUFFIXES)
def suffix_index(fx):
    return imports.file_index(fx.fx_paths).where("how = 'suffix'").select("key", "path")


ASKED = """asked AS (SELECT DISTINCT CASE WHEN ord % 4 = 0 THEN array_to_string(string_split(path, '/')[-2:], '/') WHEN ord % 4 = 1 THEN concat('@/', string_split(path, '/')[-1]) WHEN ord % 4 = 2 THEN concat('nowhere/', path) ELSE path END AS import_path FROM fx_paths)"""


def _asked(fx):
    o, p = F.col("ord") % 4, F.col("path")
    split = F.split(p, "/")
    last = F.element_at(split, -1)
    two = F.array_join(F.slice(split, F.greatest(F.size(split) - 1, F.lit(1)), 2), "/")
    made = F.when(o == 0, two).when(o == 1, F.concat(F.lit("@/"), last)).when(o == 2, F.concat(F.lit("nowhere/"), p)).otherwise(p)
    return fx.fx_paths.select(made.alias("import_path")).distinct().withColumn("file_path", F.lit("main.go")).withColumn("language", F.lit("java"))


RESOLVED = "told AS (SELECT import_path, CASE WHEN starts_with(import_path, '@/') THEN concat('src', substr(import_path, 2)) ELSE suf.path END AS resolved_path, CASE WHEN starts_with(import_path, '@/') THEN 'path-alias' WHEN suf.path IS NOT NULL THEN 'suffix' ELSE 'unresolved' END AS method, CASE WHEN starts_with(import_path, '@/') THEN 0.95 WHEN suf.path IS NOT NULL THEN 0.7 ELSE 0 END AS confidence FROM asked LEFT JOIN suf ON suf.suffix = import_path)"


@query("SELECT import_path, regexp_replace(resolved_path, '/+$', '') AS resolved_path, method, CAST(confidence AS DOUBLE) AS confidence FROM told", "fx_paths", extra=f"{SUFFIXES}, {ASKED}, {RESOLVED}")
def import_resolution(fx):
    told = imports.resolve_imports(_asked(fx), fx.fx_paths, [("@", "src")])
    return told.select("import_path", F.regexp_replace("resolved_path", "/+$", "").alias("resolved_path"), "method", "confidence")


@query("SELECT count(*) AS total, count(resolved_path) AS resolved, count(*) - count(resolved_path) AS unresolved FROM told", "fx_paths", extra=f"{SUFFIXES}, {ASKED}, {RESOLVED}")
def import_stats(fx):
    return imports.import_stats(imports.resolve_imports(_asked(fx), fx.fx_paths, [("@", "src")])).select("total", "resolved", "unresolved")


@query("SELECT path, CASE WHEN ord % 2 = 0 THEN concat('a/x', CAST(ord AS STRING)) ELSE concat('y', CAST(ord AS STRING)) END AS target FROM fx_paths", "fx_paths")
def relative_paths(fx):
    o = F.col("ord").cast("string")
    written = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("./c/../x"), o)).otherwise(F.concat(F.lit("../b/./../y"), o))
    return fx.fx_paths.select("path", imports.relative_target(written, F.lit("a/main.ts")).alias("target"))


#: Variables of parts, a file for each thousand: of ten in a row the first is declared, the second a call's result, and the others
#: follow from the one before. The fifth is declared later on, too.
BOUND = """bound AS (SELECT p_partkey AS n, p_partkey // 1000 AS f FROM part),
 owned AS (SELECT o % 40 AS o, m, (o * 7 + m * 3) % 40 AS t FROM (SELECT DISTINCT s_suppkey % 40 AS o FROM supplier) AS s, range(7) AS r(m) WHERE (o + m) % 11 <> 0),
 env AS (SELECT f, n, CASE n % 10 WHEN 2 THEN n % 30 ELSE n % 40 END AS t FROM bound WHERE n % 10 IN (1, 5) OR (n % 10 = 2 AND n % 30 % 5 <> 0)
  UNION ALL SELECT b.f, b.n, CASE WHEN b.n % 10 = 0 THEN e.t ELSE w.t END FROM env e JOIN bound b ON b.f = e.f AND b.n = e.n + 1 LEFT JOIN owned w ON w.o = e.t AND w.m = b.n % 7
  WHERE b.n % 10 NOT IN (1, 2, 5) AND (b.n % 10 = 0 OR w.t IS NOT NULL))"""


@query("SELECT concat('f', CAST(f AS STRING)) AS file_path, concat('v', CAST(n AS STRING)) AS var, concat('T', CAST(t AS STRING)) AS type FROM env", extra=BOUND)
def type_propagation(fx):
    """Types follow along chains of fields, calls and aliases until nothing new is known."""
    n = F.col("p_partkey")
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    last = n % 10
    how = F.when(last == 1, "declared").when(last == 2, "called").when(last == 0, "alias").otherwise("member")
    base = F.when(~last.isin(1, 2), text("v", n - 1))
    member = F.when(last == 2, text("fn", n % 30)).when(~last.isin(0, 1), text("m", n % 7))
    kind = F.when(last == 1, text("T", n % 40))
    each = fx.table("part").select(text("f", F.floor(n / 1000)).alias("file_path"), F.lit(0).cast("long").alias("ord"), text("v", n).alias("var"), how.alias("how"), base.alias("base"), member.alias("member"), kind.alias("type"), n.alias("n"))
    later = each.where("n % 10 = 5").select("file_path", F.lit(1).cast("long").alias("ord"), "var", F.lit("declared").alias("how"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("member"), text("T", F.col("n") % 40).alias("type"))
    o, m = F.col("o"), F.col("m")
    owners = fx.table("supplier").select((F.col("s_suppkey") % 40).alias("o")).distinct().select("o", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("m")).where((o + m) % 11 != 0)
    known = owners.select(text("T", o).alias("owner"), text("m", m).alias("member"), text("T", (o * 7 + m * 3) % 40).alias("type"))
    functions = fx.table("part").select((n % 30).alias("k")).distinct().where("k % 5 <> 0").select(F.lit("").alias("owner"), text("fn", F.col("k")).alias("member"), text("T", F.col("k")).alias("type"))
    return types.propagate(each.drop("n").unionByName(later), known.unionByName(functions))


@query(
    """SELECT p.query, p.process, p.step_count, g.process_score, g.process_rank, p.doc, p.step, p.score FROM placed p JOIN
       (SELECT *, row_number() OVER (PARTITION BY query ORDER BY process IS NULL, process_score DESC, process) AS process_rank FROM (SELECT query, process, round(sum(score), 9) AS process_score FROM placed GROUP BY ALL) AS u) AS g
       ON p.query = g.query AND p.process IS NOT DISTINCT FROM g.process""",
    extra="""steps AS (SELECT l_orderkey AS o, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step, count(*) OVER (PARTITION BY l_orderkey) AS step_count FROM lineitem),
 firsts AS (SELECT concat('proc_', CAST(o AS STRING)) AS process, k, min(step) AS step, any_value(step_count) AS step_count FROM steps GROUP BY o, k),
 placed AS (SELECT p_partkey % 7 AS query, process, step_count, p_partkey AS doc, step, 1.0::DOUBLE / (60 + p_partkey % 50) AS score FROM part LEFT JOIN firsts ON k = p_partkey)""",
)
def search_by_process(fx):
    """Hits grouped by the process that they are steps of: orders stand for processes, and their parts for steps."""
    lines = fx.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    flows = lines.select(F.concat(F.lit("proc_"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("").alias("label"), F.lit("").alias("process_type"), F.size("lines").cast("long").alias("step_count"), F.col("lines.l_partkey").alias("trace"))
    n = F.col("p_partkey")
    hits = fx.table("part").select((n % 7).alias("query"), n.alias("doc"), (1.0 / (60 + n % 50)).alias("score"))
    found = search.by_process(hits, flows)
    return found.select("query", "process", "step_count", "process_score", F.col("process_rank").cast("long").alias("process_rank"), "doc", F.col("step").cast("long").alias("step"), "score")


#: A document's words become names, as far as they are letters: what a source defines, calls and imports hangs on its text.
WORDS_OF = "words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) > 3)[1:3] AS w FROM documents), made AS (SELECT doc_id, w[1] AS a, w[2] AS b FROM words WHERE len(w) >= 2)"


@query(
    f"""SELECT kind, n FROM (SELECT 'Folder' AS kind, count(*) AS n FROM (SELECT DISTINCT 'pkg' FROM documents) AS u UNION ALL SELECT 'File', count(DISTINCT doc_id) FROM documents
       UNION ALL SELECT 'Class', count(*) FROM made UNION ALL SELECT 'Method', count(*) FROM made UNION ALL SELECT 'CONTAINS', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'DEFINES', 2 * count(*) FROM made
       UNION ALL SELECT 'IMPORTS', count(*) FROM made m WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = m.doc_id - 1)
       UNION ALL SELECT 'CALLS', count(*) FROM made m WHERE (SELECT count(*) FROM made o WHERE o.a = m.b) = 1
       UNION ALL SELECT 'EXTENDS', count(*) FROM made m WHERE EXISTS (SELECT 1 FROM made o WHERE o.doc_id = m.doc_id - 1)) AS u WHERE n > 0""",
    extra=WORDS_OF,
)
def ingest_text(fx):
    """Documents as small sources, named by their words, taken through the whole ingestion. A call of a name that only one
    method has is an edge; one that several have is none."""
    docs = fx.table("documents")
    before = F.concat(F.lit("C"), (F.col("doc_id") - 1).cast("string"))
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3), 1, 3)
    code = F.concat(F.lit("import pkg.m"), (F.col("doc_id") - 1).cast("string"), F.lit("\n\nclass C"), F.col("doc_id").cast("string"), F.lit("("), before, F.lit("):\n    def "), words[0], F.lit("(self, x):\n        return "), words[1], F.lit("(x)\n"))
    files = docs.select(F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.when(F.size(words) >= 2, code).otherwise("").alias("content"))
    made = ingest.build(files)
    return made.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).unionByName(made.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT count(*) FILTER (WHERE NOT big) AS total_files, CAST(coalesce(sum(n) FILTER (WHERE NOT big), 0) AS BIGINT) AS total_size, count(*) FILTER (WHERE big) AS skipped_files, CAST(coalesce(sum(n) FILTER (WHERE big), 0) AS BIGINT) AS skipped_size FROM (SELECT octet_length(encode(text)) AS n, octet_length(encode(text)) > 4000 AS big FROM documents WHERE doc_id % 3 <> 0) AS u")
def walk_stats(fx):
    docs = fx.table("documents")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "dist/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), F.col("text").cast("binary").alias("content"))
    return walk.walk_stats(walk.of_files(files, walk.WalkOptions(max_file_size=4000, read_content=False)))


TERMS = """words AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM documents), lens AS (SELECT doc, count(*) AS len FROM words GROUP BY doc),
 corpus AS (SELECT count(*) AS n_docs, CAST(sum(coalesce(len, 0)) AS DOUBLE) / count(*) AS mean_len FROM documents LEFT JOIN lens ON doc = doc_id),
 asked AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
 tf AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 scored AS (SELECT query, doc, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc), corpus GROUP BY query, doc),
 bm AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""


def _bm25(fx, k=10):
    docs = fx.table("documents").select(F.col("doc_id").alias("doc"), "text")
    return search.bm25(docs, fx.table("benchmark").select(F.col("item_id").alias("query"), "text"), k)


@query("SELECT query, doc, score, rank FROM bm WHERE rank <= 10", extra=TERMS)
def bm25_topk(fx):
    return _bm25(fx).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


NEAR = """near AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
 nn AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM near)"""


def _nearest(fx, k=10):
    vectors = fx.table("embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return search.nearest(vectors, vectors.where("doc % 100 = 0").withColumnRenamed("doc", "query"), k)


@query("SELECT query, doc, score, rank FROM nn WHERE rank <= 10", extra=NEAR)
def vector_topk(fx):
    return _nearest(fx).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query // 100, doc, rank FROM nn WHERE rank <= 10) AS r GROUP BY query, doc) AS u) AS v WHERE rank <= 10",
    extra=f"{TERMS}, {NEAR}",
)
def hybrid_rrf(fx):
    dense = _nearest(fx).withColumn("query", F.floor(F.col("query") / 100))
    return search.fuse([_bm25(fx), dense]).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "SELECT node, min(depth) AS depth FROM walk GROUP BY node", "fx_calls",
    extra="changed AS (SELECT DISTINCT id FROM fx_nodes WHERE file_path LIKE 'src/brand11/%' AND start_line <= 20 AND end_line >= 10), walk AS (SELECT id AS node, 0 AS depth FROM changed UNION SELECT source_id, depth + 1 FROM walk JOIN fx_calls ON target_id = node WHERE depth < 3)",
)
def change_impact(fx):
    changes = fx.fx_nodes.where("file_path like 'src/brand11/%'").select("file_path").distinct().select("file_path", F.lit(10).alias("first"), F.lit(20).alias("last"))
    return search.change_impact(changes, fx.fx_nodes, fx.fx_calls, 3)


@query(
    """SELECT file_path, coalesce(g, 0) AS graph_edits, CAST(coalesce(t, 0) AS INT) AS text_edits FROM
       (SELECT file_path, count(*) AS g FROM (SELECT n.file_path FROM fx_calls c JOIN fx_nodes n ON n.id = c.source_id WHERE c.target_id = (SELECT id FROM busiest) UNION ALL SELECT file_path FROM fx_nodes WHERE id = (SELECT id FROM busiest)) AS u GROUP BY file_path) AS a
       FULL JOIN (SELECT file_path, count(*) AS t FROM fx_nodes WHERE name = (SELECT name FROM fx_nodes WHERE id = (SELECT id FROM busiest)) GROUP BY file_path) AS b USING (file_path)""",
    "fx_calls", extra="busiest AS (SELECT target_id AS id FROM fx_calls GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 1)",
)
def rename_preview(fx):
    """The most called symbol, in files that have the names of their symbols as text."""
    best = fx.fx_calls.groupBy("target_id").count().orderBy(F.desc("count"), "target_id").first()[0]
    files = fx.fx_nodes.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.collect_list("name"), "(x); ").alias("content"))
    return search.rename_preview(fx.fx_nodes, fx.fx_calls, files, best)


@query("SELECT target_id AS id, 'area' AS label, count(*) AS size FROM fx_member GROUP BY target_id", "fx_member")
def community_tool(fx):
    """All communities, as the tool of that name lists them."""
    from ..tools import Engine

    graph = graph_of(fx)
    groups = fx.fx_member.select(F.col("target_id").alias("id")).distinct().select("id", F.lit("Community").alias("kind"), F.lit("area").alias("name"))
    return Engine(graph.add_nodes(groups)).call("community", list_all=True)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(fx):
    return incremental.windowed_counts(fx.table("events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(
    "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events) AS u) AS v GROUP BY user_id, s"
)
def event_sessions(fx):
    return incremental.sessions(fx.table("events")).select("user_id", "n")


@query(
    "SELECT entity, id FROM (SELECT 'node' AS entity, id FROM fx_nodes UNION ALL SELECT 'edge', id FROM fx_calls) AS u", "fx_calls",
)
def graph_first_wins(fx):
    """A graph from rows that repeat ids: the first of each stays."""
    nodes, edges = fx.fx_nodes, fx.fx_calls
    made = Graph.of(nodes.unionByName(nodes.withColumn("ord", F.col("ord") + 1_000_000)), edges.unionByName(edges.withColumn("ord", F.col("ord") + 1)), validate=True)
    return made.nodes.select(F.lit("node").alias("entity"), "id").unionAll(made.edges.select(F.lit("edge").alias("entity"), "id"))


@query("SELECT 'n' AS part, kind, count(*) AS n FROM fx_nodes GROUP BY kind UNION ALL SELECT 'e', kind, count(*) FROM fx_edges GROUP BY kind", "fx_edges")
def sql_passthrough(fx):
    from ..tools import Engine

    text = "SELECT 'n' AS part, kind, count(*) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT 'e', kind, count(*) FROM {edges} GROUP BY kind"
    return Engine(graph_of(fx)).call("sql", query=text)
