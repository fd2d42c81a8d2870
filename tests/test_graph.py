"""The graph, its filters and changes, and the traversals."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lodegraph import graph as G
from lodegraph.functions import paths, text
from lodegraph.operators import calls, heritage, iterate, traverse

NODE = "id string, kind string, name string, file_path string, start_line int, end_line int, language string, is_exported boolean, ord bigint"
EDGE = "id string, source_id string, target_id string, kind string, confidence double, ord bigint"


def nodes_of(spark, rows):
    made = [(i, k, n, f, s, s + 5, "typescript", e, o) for o, (i, k, n, f, s, e) in enumerate(rows)]
    return spark.createDataFrame(made, NODE)


def edges_of(spark, rows):
    return spark.createDataFrame([(f"{a}->{b}:{k}", a, b, k, c, o) for o, (a, b, k, c) in enumerate(rows)], EDGE)


@pytest.fixture(scope="module")
def chain(spark):
    nodes = nodes_of(spark, [("f:main", "Function", "main", "src/main.ts", 1, True), ("f:greet", "Function", "greet", "src/greet.ts", 1, True), ("f:save", "Method", "save", "src/db.ts", 9, False), ("c:User", "Class", "User", "src/user.ts", 1, None)])
    edges = edges_of(spark, [("f:main", "f:greet", "CALLS", 1.0), ("f:greet", "f:save", "CALLS", 1.0), ("f:main", "x:gone", "CALLS", 0.5)])
    return G.Graph(nodes, edges)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_filters(chain):
    assert ids(chain.find_nodes(kind=["Function"])) == ["f:greet", "f:main"]
    assert ids(chain.find_nodes(is_exported=False)) == ["f:save"]  # not known is not false
    assert ids(chain.find_nodes(name="^gr", file_path="greet")) == ["f:greet"]
    assert ids(chain.find_nodes(kind="", name="")) == ids(chain.nodes)
    assert ids(chain.find_edges(kind="CALLS", min_confidence=0.8)) == ["f:greet->f:save:CALLS", "f:main->f:greet:CALLS"]
    assert ids(G.NodeQuery(chain).where_kind("Class").where_kind("Method").find_nodes()) == ["f:save"]
    assert ids(G.NodeQuery(chain).find_connected("f:main", 2)) == ["f:greet", "f:main"]
    assert ids(G.search(chain.nodes, name="GREET")) == ["f:greet"] and ids(G.search(chain.nodes, exported=False)) == ["c:User", "f:save"]
    assert ids(G.search(chain.nodes)) == []
    assert ids(G.top_matches(chain.nodes, "MAIN")) == ["f:main"]
    assert ids(chain.node("f:main")) == ["f:main"] and ids(chain.outgoing("f:main"), "target_id") == ["f:greet", "x:gone"]


def test_changes(spark, chain):
    assert ids(chain.dangling()) == ["f:main->x:gone:CALLS"]
    left = chain.remove_nodes(chain.nodes.where("id = 'f:greet'"))
    assert ids(left.nodes) == ["c:User", "f:main", "f:save"] and ids(left.edges) == ["f:main->x:gone:CALLS"]
    assert {(r["change"], r["id"]) for r in left.diff(chain).where("entity = 'node'").collect()} == {("removed", "f:greet")}
    twice = chain.add_nodes(chain.nodes.withColumn("name", F.lit("other")))
    assert twice.nodes.where("name = 'other'").isEmpty()
    renamed = chain.apply(updated_nodes=chain.nodes.where("id = 'c:User'").withColumn("name", F.lit("Account")))
    assert renamed.node("c:User").first()["name"] == "Account" and renamed.nodes.count() == 4
    assert G.Graph.of(chain.nodes.unionByName(chain.nodes), chain.edges, validate=True).edges.count() == 2
    told = chain.metadata().first()
    assert (told["node_count"], told["edge_count"], told["languages"], told["node_kinds"]["Function"]) == (4, 3, ["typescript"], 2)
    assert G.Graph.empty(spark).metadata().first()["node_count"] == 0


def test_neighbours_and_symbols(spark, chain):
    root = spark.createDataFrame([("f:greet",)], "root string")
    assert ids(chain.neighbors(root)) == ["f:main", "f:save"] and ids(chain.related(root, "CALLS")) == ["f:main", "f:save"]
    asked = spark.createDataFrame([("save",), ("f:main",), ("nobody",), ("f:none",)], "symbol string")
    assert {r["symbol"]: r["id"] for r in G.resolve_symbols(chain.nodes, asked).collect()} == {"save": "f:save", "f:main": "f:main", "nobody": None, "f:none": None}
    assert {r["id"]: (r["fan_out"], r["fan_in"]) for r in chain.degrees().collect()}["f:greet"] == (1, 1)
    assert G.inverted_index(chain.nodes, "kind").where("kind = 'Function'").first()["ids"] == ["f:main", "f:greet"]


def test_diamond_path(spark):
    edges = edges_of(spark, [("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("c", "d", "CALLS", 1.0), ("a", "d", "CALLS", 1.0)])
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("a", "z")], "src string, dst string")
    directed = {(r["src"], r["dst"]): (r["length"], r["path"]) for r in traverse.shortest_paths(edges, pairs).collect()}
    assert directed == {("a", "d"): (1, ["a", "d"]), ("d", "a"): (-1, []), ("a", "a"): (0, ["a"]), ("a", "z"): (-1, [])}
    assert traverse.shortest_paths(edges, pairs, directed=False).where("src = 'd'").first()["length"] == 1
    every = traverse.all_paths(edges, pairs.where("dst = 'd'"), 3)
    assert sorted(r["path"] for r in every.collect()) == [["a", "b", "c", "d"], ["a", "d"]]
    assert traverse.all_paths(edges, pairs.where("dst = 'd'"), 2).count() == 1


def test_traversals_against_plain_search(spark):
    r = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    links = [(r.choice(names), r.choice(names)) for _ in range(70)]
    nodes = nodes_of(spark, [(n, "File" if i % 9 == 4 else "Function", n, "p", 1, True) for i, n in enumerate(names)])
    edges = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in links])
    files = {n for i, n in enumerate(names) if i % 9 == 4}
    starts = spark.createDataFrame([("n00",), ("n13",)], "root string")

    def search(start, direction, limit, skip=frozenset()):
        near = defaultdict(set)
        for a, b in links:
            if direction in ("out", "both"):
                near[a].add(b)
            if direction in ("in", "both"):
                near[b].add(a)
        depth, queue = {start: 0}, deque([start])
        while queue:
            n = queue.popleft()
            for m in near[n] - depth.keys() - skip if depth[n] < limit else ():
                depth[m] = depth[n] + 1
                queue.append(m)
        return {(start, n, d) for n, d in depth.items() if d}

    both = lambda direction, limit, skip=frozenset(): search("n00", direction, limit, skip) | search("n13", direction, limit, skip)
    rows = lambda df: {(x["root"], x["node"], x["depth"]) for x in df.collect()}
    assert rows(traverse.khop(edges, starts, 3)) == both("both", 3)
    assert rows(traverse.khop_exclusive(edges, starts, 3)) == both("both", 2)
    assert rows(traverse.impact(nodes, edges, starts)) == both("out", 5, files)
    assert rows(traverse.impact(nodes, edges, starts, "upstream", 2)) == both("in", 2, files)
    assert rows(traverse.impact(nodes, edges, starts, "both", 2, strict_compat=True)) == both("in", 2, files)
    assert traverse.by_depth(traverse.impact(nodes, edges, starts)).agg(F.sum("n")).first()[0] == len(both("out", 5, files))


def test_context(spark, chain):
    root = spark.createDataFrame([("f:greet",)], "root string")
    assert {(r["role"], r["node"], r["depth"]) for r in traverse.context(chain.nodes, chain.edges, root).collect()} == {("caller", "f:main", 1), ("callee", "f:save", 1)}


def test_text_and_paths(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.half_up(F.lit(-2.5), 0)) == -2.0 and get(text.half_up(F.lit(0.125), 2)) == 0.13
    assert get(text.clean_id(F.lit("a b__init__!" + "x" * 300))) == ("a_b_init_" + "x" * 300)[:200]
    assert get(text.name_prefix(F.lit("getUser_name"))) == "get" and get(text.name_prefix(F.lit("_x"))) == "_x"
    assert get(paths.normalise(F.lit("/a/./b/../../../c//d"))) == "/c/d" and get(paths.normalise(F.lit("a/../.."))) == ".." and get(paths.normalise(F.lit("./"))) == "."
    assert [get(paths.parent(F.lit(p))) for p in ("a", "/a", "a/b")] == [".", "/", "a"]
    assert [get(paths.extension(F.lit(p))) for p in ("a/b.TS", "a.b/c", ".gitignore")] == ["ts", None, "gitignore"]
    assert get(paths.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"] and get(paths.prefixes(F.lit("a/b"))) == ["a", "a/b"]


def test_paths_and_ancestors_have_no_bound(spark):
    names = [f"n{i:03d}" for i in range(121)]
    calls = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in zip(names, names[1:])])
    pairs = spark.createDataFrame([("n000", "n120"), ("n120", "n000"), ("n000", "n000"), ("n000", "none")], "src string, dst string")
    found = {(r["src"], r["dst"]): (r["length"], r["path"]) for r in traverse.shortest_paths(calls, pairs.limit(3)).collect()}
    assert found == {("n000", "n120"): (120, names), ("n120", "n000"): (-1, []), ("n000", "n000"): (0, ["n000"])}
    up = edges_of(spark, [(a, b, "EXTENDS", 1.0) for a, b in zip(names, names[1:])])
    above = heritage.ancestors(up, spark.createDataFrame([("n000",)], "root string"))
    assert {r["node"]: r["depth"] for r in above.collect()} == {n: i for i, n in enumerate(names) if i}


def test_shortest_paths_against_plain_search(spark):
    r = random.Random(9)
    names = [f"n{i:02d}" for i in range(25)]
    links = sorted({(r.choice(names), r.choice(names)) for _ in range(50)})
    edges = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in links])
    asked = [(a, b) for a in names for b in names[:9]]
    for directed in (True, False):
        near = defaultdict(set)
        for a, b in links:
            near[a].add(b)
            if not directed:
                near[b].add(a)
        best = {}
        for a in names:
            level = {a: [a]}
            while level:
                for n, path in level.items():
                    best[a, n] = path
                grown = sorted((path + [m], m) for n, path in level.items() for m in near[n] if (a, m) not in best)
                level = {}
                for path, m in grown:
                    level.setdefault(m, path)
        out = traverse.shortest_paths(edges, spark.createDataFrame(asked, "src string, dst string"), directed).collect()
        assert {(x["src"], x["dst"]): (x["length"], x["path"]) for x in out} == {p: (len(best[p]) - 1, best[p]) if p in best else (-1, []) for p in asked}


def chains(spark, count, length):
    """Chains of nodes, the numbers of one after those of another."""
    ids = [(f"Function:c{c:03}/{i}", "Function", c * length + i) for c in range(count) for i in range(length)]
    nodes = spark.createDataFrame(ids, "id string, kind string, ord bigint")
    edges = [(a[0], b[0]) for a, b in zip(ids, ids[1:]) if a[2] // length == b[2] // length]
    return nodes, spark.createDataFrame(edges, "source_id string, target_id string")


def test_reach_by_number_keeps_starts_together(spark, monkeypatch):
    """Starts of a part of the graph share a block, so that a node has a row for its part's starts and none for others;
    what is shuffled on the way is not kept."""
    nodes, edges = chains(spark, 4, 64)
    names = iterate.numbered(nodes)
    ends = [names.select(F.col("id").alias(c), F.col("n").alias(n)) for c, n in (("source_id", "src"), ("target_id", "dst"))]
    pairs = edges.join(ends[0], "source_id").join(ends[1], "target_id").select("src", "dst")
    written, cut = [], iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda df: written.append(cut(df)) or written[-1])
    told = iterate.reach(pairs, names.select(F.col("n").alias("root")), None, names)
    want = {(f"Function:c{c:03}/{i}", f"Function:c{c:03}/{j}", j - i) for c in range(4) for i in range(64) for j in range(i, 64)}
    assert {tuple(r) for r in told.collect()} == want
    assert max(t.count() for t in written) == 4 * 64


def test_by_depth_shuffles_no_reached_rows(spark):
    nodes, edges = chains(spark, 2, 5)
    names = iterate.numbered(nodes)
    n = {r["id"]: r["n"] for r in names.collect()}
    pairs = spark.createDataFrame([(n[a], n[b]) for a, b in edges.collect()], "src bigint, dst bigint")
    told = traverse.by_depth(iterate.reach(pairs, names.select(F.col("n").alias("root")), 3, names, by_block=True))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(root" not in plan
    assert {(r["root"], r["depth"]): r["nodes"] for r in told.collect()}["Function:c001/1", 2] == ["Function:c001/3"]


def test_sites_are_worked_out_once_for_types(spark):
    """Types are looked up three ways; the sites below are read for them once, and once for the rows told."""
    sites = spark.createDataFrame([("s1", "save", "f", "T"), ("s2", "load", "f", None)], "site string, called_name string, file_path string, receiver_type string")
    symbols = spark.createDataFrame([("Method:T/save", "Method", "save"), ("Method:U/save", "Method", "save")], "id string, kind string, name string")
    told = calls.resolve(sites, symbols)
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD [site") == 1
    assert {r["site"]: r["target_id"] for r in told.collect()} == {"s1": "Method:T/save", "s2": None}


@pytest.mark.parametrize("name", ["call_resolution", "call_resolution_stats", "call_confidence"])
def test_sites_read_lines_once(spark, name):
    """The calls are a written table before types are told: what is returned reads no line of the table below them."""
    from lodegraph import catalog

    told = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in told.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["call_traces", "process_stats", "process_write_back"])
def test_flows_read_calls_once(spark, name):
    """The calls are a written table before the rounds begin: what is returned reads no line of the table below them."""
    from lodegraph import catalog

    told = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in told.inputFiles() if "lineitem" in f]


def test_shortest_paths_keep_distances_in_blocks(spark, monkeypatch):
    """How far nodes are from 64 targets is a row a node and level where targets are met, not one for each target."""
    _, edges = chains(spark, 1, 70)
    names = [f"Function:c000/{i}" for i in range(70)]
    pairs = spark.createDataFrame([(names[0], n) for n in names[:8]] + [(n, n) for n in names[:64]], "src string, dst string").distinct()
    hub = edges.unionAll(spark.createDataFrame([(n, names[0]) for n in names[1:]] , edges.schema))
    written, cut = [], iterate.cut
    for module in (iterate, traverse):
        monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    told = {(r["src"], r["dst"]): (r["length"], r["path"]) for r in traverse.shortest_paths(hub, pairs, max_depth=3).collect()}
    assert told[names[0], names[3]] == (3, names[:4]) and told[names[0], names[7]] == (-1, []) and told[names[5], names[5]] == (0, [names[5]])
    assert max(t.count() for t in written) <= 2 * 70


def test_shortest_paths_look_no_further_than_a_pair(spark, monkeypatch):
    """Rounds end when every pair is settled, however far the graph goes on behind its ends."""
    _, edges = chains(spark, 1, 60)
    pairs = spark.createDataFrame([("Function:c000/50", "Function:c000/53"), ("Function:c000/50", "Function:none")], "src string, dst string")
    written, cut = [], iterate.cut
    for module in (iterate, traverse):
        monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    told = {r["dst"]: (r["length"], r["path"]) for r in traverse.shortest_paths(edges, pairs).collect()}
    assert told == {"Function:c000/53": (3, [f"Function:c000/{i}" for i in range(50, 54)]), "Function:none": (-1, [])}
    assert len(written) <= 30


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5])
def test_all_paths_against_plain_search(spark, limit):
    """Paths over cycles, parallel edges and an edge to itself, by id and by number."""
    r = random.Random(limit)
    names = [f"n{i}" for i in range(9)]
    links = [(r.choice(names), r.choice(names)) for _ in range(24)] + [("n1", "n2")] * 2 + [("n3", "n3")]
    asked = [("n1", "n2"), ("n1", "n2"), ("n2", "n1"), ("n4", "n4"), ("n0", "n8"), ("n0", "n7"), ("n5", "gone")]

    def search(path, dst):
        if path[-1] == dst:
            return [tuple(path)]
        return [p for a, b in links if a == path[-1] and b not in path and len(path) <= limit for p in search([*path, b], dst)]

    want = sorted(p for a, b in set(asked) if a != b for p in search([a], b))
    pairs = spark.createDataFrame(asked, "src string, dst string")
    edges = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in links])
    number = spark.createDataFrame([(n, 7 * i) for i, n in enumerate(names)], "id string, n bigint")
    by_number = edges.select("source_id", "target_id").replace({n: str(7 * i) for i, n in enumerate(names)}).selectExpr("bigint(source_id) source_id", "bigint(target_id) target_id")
    for told in (traverse.all_paths(edges, pairs, limit), traverse.all_paths(by_number, pairs, limit, names=number)):
        rows = told.collect()
        assert sorted(tuple(x["path"]) for x in rows) == want and all((x["path"][0], x["path"][-1]) == (x["src"], x["dst"]) for x in rows)


def test_all_paths_grow_once_for_all_pairs(spark, monkeypatch):
    """Sources that share their ways meet targets that nothing leads to: what is written holds no path for each pair, and
    none beyond half of the length."""
    wide = [[f"{x}{i}" for i in range(6)] for x in "abcd"]
    links = [("s", m) for m in wide[0]] + [(m, n) for x, y in zip(wide, wide[1:]) for m in x for n in y] + [("d0", "t0")]
    edges = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in links])
    pairs = spark.createDataFrame([("s", x) for x in [f"d{i}" for i in range(6)] + ["t0"]], "src string, dst string")
    written, cut = [], iterate.cut
    monkeypatch.setattr(traverse, "cut", lambda df: written.append(cut(df)) or written[-1])
    assert traverse.all_paths(edges, pairs).count() == 6 * 6**3 + 6**3
    # ways, pairs, heads and tails; then a row of two numbers for each path
    assert max(t.count() for t in written if "head" not in t.columns) <= len(links) + 7 * 6**2 and all(t.count() <= 7 * 6**3 for t in written)
