"""Communities, processes, inheritance and calls."""

import random

import pytest
from pyspark.sql import functions as F
from test_graph import edges_of, ids, nodes_of

from lodegraph.operators import calls, community, heritage, process


@pytest.fixture(scope="module")
def three(spark):
    names = [(f"{g}{i}", f"src/{g}/{g}{i}.ts") for g, n in (("a", 3), ("b", 3), ("c", 2)) for i in range(1, n + 1)]
    nodes = nodes_of(spark, [(n, "Function", n, p, 1, True) for n, p in names])
    links = [("a1", "a2", 1.0), ("a2", "a3", 1.0), ("a1", "a3", 1.0), ("b1", "b2", 1.0), ("b2", "b3", 1.0), ("c1", "c2", 1.0), ("a3", "b1", 0.5), ("b3", "c1", 0.3)]
    return nodes, edges_of(spark, [(a, b, "CALLS", c) for a, b, c in links])


def test_clusters(three):
    nodes, edges = three
    weights = community.call_weights(nodes, edges)
    assert community.components(weights).select("component").distinct().count() == 1
    found = {r["node"]: r["component"] for r in community.clusters(weights).collect()}
    assert len(found) == 8 and {found[x] for x in ("a1", "a2", "a3")} == {"a1"} and found["b1"] == found["b3"] != "a1"
    members = community.clusters(weights)
    assert all(0 <= r["cohesion"] <= 1 for r in community.cohesion(weights, members).collect())
    assert community.modularity(weights, members).first()["q"] > 0.3
    assert {r["label"] for r in community.labels(members, nodes).collect()} <= {"A", "B", "C"}
    assert community.clusters(weights.limit(0)).count() == 0
    stats = {r["component"]: r for r in community.cluster_stats(weights, members).collect()}
    assert stats["a1"]["internal"] == 3.0 and stats["a1"]["external"] == 0.5 and stats["a1"]["density"] == 1.0


def test_merge(spark):
    rows = [("x", 0, ["1", "2", "3"], 0.5), ("y", 1, ["2", "3", "4"], 1.0), ("z", 2, ["9"], 1.0), ("w", 3, [str(i) for i in range(1, 12)], 1.0)]
    out = {r["component"]: r for r in community.merge_similar(spark.createDataFrame(rows, "component string, ord int, members array<string>, cohesion double")).collect()}
    assert set(out) == {"x", "z", "w"} and out["x"]["merged"] == ["y"] and out["x"]["members"] == ["1", "2", "3", "4"] and out["x"]["symbol_count"] == 6 and out["x"]["cohesion"] == 0.75


def plain_traces(entry, near, limit=10, least=3, most=12):
    queue, met, out = [(entry, [entry])], set(), []
    while queue and len(out) < most:
        node, path = queue.pop(0)
        if node in met:
            continue
        met.add(node)
        nexts = near.get(node, [])[:4]
        if not nexts or len(path) - 1 >= limit:
            if len(path) >= least:
                out.append(path)
            continue
        grown = [(m, [*path, m]) for m in nexts if m not in path]
        queue += grown
        if not grown and len(path) >= least:
            out.append(path)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_against_a_queue(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    links = [(r.choice(names), r.choice(names)) for _ in range(55)]
    edges = edges_of(spark, [(a, b, "CALLS", 1.0) for a, b in links])
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    entries = spark.createDataFrame([(n,) for n in names[:12]], "entry string")
    got = process.traces(entries, edges).orderBy("entry", "place").collect()
    for n in names[:12]:
        assert [x["trace"] for x in got if x["entry"] == n] == plain_traces(n, near)


@pytest.mark.parametrize("names", [["a", "ba", "b", "ab"], ["Function:part/1", "Function:part/12", "Method:part/12", "part/1", "art", "n:p"]])
def test_dedup_by_substring(spark, names):
    r = random.Random(4)
    made = {tuple(r.choice(names) for _ in range(r.randint(1, 9))) for _ in range(150)}
    made |= {t[i:j] for t in list(made)[:40] for i, j in [sorted(r.sample(range(len(t) + 1), 2))]} | {("art/1",), ("nothing",)}
    made = sorted(made, key=lambda t: (-len(t), t))
    frame = spark.createDataFrame([(list(t), i) for i, t in enumerate(made)], "trace array<string>, rank1 int")
    kept = []
    for t in made:
        if not any("->".join(t) in "->".join(k) for k in kept):
            kept.append(t)
    assert len(kept) < len(made) - 30
    assert sorted(tuple(x["trace"]) for x in process.drop_contained(frame).collect()) == sorted(kept)


def test_processes(spark, three):
    nodes, edges = three
    belongs = spark.createDataFrame([("a1", "A", 0), ("b2", "B", 0), ("b2", "C", 1)], "node_id string, community_id string, ord int")
    found = process.processes(nodes, edges, belongs, min_confidence=0.3).orderBy("idx").collect()
    assert found[0]["trace"][0] == "a1" and found[0]["process_type"] == "cross_community" and found[0]["communities"] == ["A", "C"] and found[0]["id"] == "proc_0_a1"
    assert process.process_steps(process.processes(nodes, edges, belongs)).agg(F.min("step")).first()[0] == 1
    scores = {r["id"]: r["score"] for r in process.entry_scores(nodes, edges).collect()}
    assert scores["a1"] == 4.0 and scores["c2"] == 0.0
    more, links = process.write_back(process.processes(nodes, edges, belongs))
    assert more.where("kind <> 'Process'").isEmpty() and links.where("step < 1").isEmpty()


def test_inheritance(spark):
    edges = edges_of(spark, [("Dog", "Animal", "EXTENDS", 1.0), ("Dog", "Pet", "IMPLEMENTS", 0.95), ("Animal", "Thing", "EXTENDS", 1.0), ("Cat", "Animal", "EXTENDS", 1.0)])
    root = spark.createDataFrame([("Dog",)], "root string")
    assert ids(heritage.ancestors(edges, root), "node") == ["Animal", "Thing"]
    assert heritage.common_ancestors(edges, spark.createDataFrame([("Dog", "Cat"), ("Dog", "Pet")], "a string, b string")).orderBy("b").collect() == [("Dog", "Cat", "Animal"), ("Dog", "Pet", None)]
    assert {r["id"]: r["kind"] for r in heritage.inheritance_nodes(nodes_of(spark, []), edges).collect()}["Pet"] == "interface"


def test_c3(spark):
    class O: ...  # noqa: E742
    class A(O): ...
    class B(O): ...
    class C(A, B): ...
    class D(B): ...
    class E(C, D): ...

    parents = {k.__name__: [b.__name__ for b in k.__bases__ if b is not object] for k in (A, B, C, D, E)}
    parents |= {"X": ["P", "Q"], "P": ["R", "S"], "Q": ["S", "R"], "XX": ["X"], "Y": ["Z"], "Z": ["Y", "A"], "YY": ["Y"]}
    long = {f"l{i}": [f"l{i + 1}"] for i in range(40)}
    edges = edges_of(spark, [(c, p, "EXTENDS", 1.0) for c, ps in (parents | long).items() for p in ps])
    asked = spark.createDataFrame([(i,) for i in (*parents, "U", "l0")], "id string")
    out = {r["id"]: (r["linearization"], r["consistent"]) for r in heritage.linearisations(edges, asked).collect()}
    for k in (A, B, C, D, E):
        assert out[k.__name__] == ([c.__name__ for c in k.__mro__ if c is not object], True)
    assert out["X"] == (["R", "S", "P", "Q", "X"], False) and out["XX"] == (["R", "S", "P", "Q", "X", "XX"], False)
    assert out["Y"] == (["O", "A", "Z", "Y"], False) and out["YY"] == (["O", "A", "Z", "Y", "YY"], False)
    assert out["U"] == (["U"], True) and out["l0"] == ([f"l{i}" for i in range(41)], True) and set(out) == {*parents, "U", "l0"}


def test_merge_of_linearisations():
    """Against the merge as it is usually written."""

    def plain(lists):
        out, lists = [], [list(x) for x in lists if x]
        while lists:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
            if head is None:
                return None
            out.append(head)
            lists = [rest for x in lists if (rest := x[1:] if x[0] == head else x)]
        return out

    r = random.Random(5)
    for _ in range(2000):
        lists = [r.sample("abcdef", r.randint(0, 5)) for _ in range(r.randint(0, 4))]
        assert heritage.merged(lists) == plain(lists)
    assert heritage.merged([[str(i) for i in range(50_000)], ["0"]]) == [str(i) for i in range(50_000)]


def test_linearisations_and_conflicts(spark):
    edges = edges_of(spark, [("C", "A", "EXTENDS", 1.0), ("C", "B", "EXTENDS", 1.0), ("A", "O", "EXTENDS", 1.0), ("B", "O", "EXTENDS", 1.0)])
    linear = heritage.linearisations(edges, spark.createDataFrame([("C",), ("Z",)], "id string"))
    assert {r["id"]: r["linearization"] for r in linear.collect()} == {"C": ["C", "A", "B", "O"], "Z": ["Z"]}
    methods = spark.createDataFrame([("A", "run"), ("B", "run"), ("O", "only")], "owner string, method string")
    assert heritage.method_conflicts(linear, methods).collect() == [("C", "run", ["A", "B"], "A")]


def test_call_text(spark):
    one = spark.createDataFrame([('greet("world")',), ("user.save()",), ("new User()",), ("Cls::make()",), ("$this->go()",)], "t string")
    told = [tuple(r) for r in one.select(calls.call_form(F.col("t")), calls.receiver(F.col("t"))).collect()]
    assert told == [("free", None), ("member", "user"), ("constructor", None), ("static", None), ("member", "this")]


def test_call_resolution(spark):
    nodes = nodes_of(spark, [("F:greet", "Function", "greet", "a.ts", 1, True), ("C:User", "Class", "User", "b.ts", 1, True), ("M:User.save", "Method", "save", "b.ts", 2, True), ("M:Log.save", "Method", "save", "c.ts", 2, True)])
    rows = [("1", "m", "x.ts", "greet", "free", None, None), ("2", "m", "x.ts", "unknown", "free", None, None), ("3", "m", "x.ts", "save", "member", "u", "User"), ("4", "m", "x.ts", "save", "member", "u", None), ("5", "m", "x.ts", "User", "constructor", None, None)]
    sites = spark.createDataFrame(rows, "site string, source_id string, file_path string, called_name string, call_form string, receiver string, receiver_type string")
    out = {r["site"]: (r["target_id"], r["failure"]) for r in calls.resolve(sites, nodes).collect()}
    assert out == {"1": ("F:greet", None), "2": (None, "no candidates"), "3": ("M:User.save", None), "4": (None, "multiple candidates"), "5": (None, "no candidates")}
    told = calls.confidence(F.lit("free"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("m"), F.lit(False))
    scored = spark.createDataFrame([("exact-match",), ("global",)], "m string").select(told["score"], told["level"]).collect()
    assert [tuple(r) for r in scored] == [(0.8, "high"), (0.48, "low")]
    assert calls.call_stats(calls.resolve(sites, nodes)).first()["resolved"] == 2
    assert calls.call_edges(calls.resolve(sites, nodes)).count() == 2


def test_names_on_a_third_of_all_rows(spark, monkeypatch):
    """Calls and symbols of one name, against trying every candidate; and no product of the two on the way."""
    r = random.Random(7)
    symbols = [(f"Method:src/f{i % 40}.ts:Type{i}.get", "Method", "get", f"src/f{i % 40}.ts", 1, True) for i in range(300)]
    symbols += [(f"Function:src/f{i % 40}.ts:fn{i}", "Function", f"fn{i % 350}", f"src/f{i % 40}.ts", 1, True) for i in range(600)]
    nodes = nodes_of(spark, symbols)
    types = [None, "Type7", "Type299", "Type300", "Type1.get", "get", "s/f3", "f3.ts:Type3.get", "zz", "M", "fn5"]
    rows = [(str(i), "m", f"src/f{r.randint(0, 45)}.ts", "get" if i % 3 else r.choice(["fn1", "fn349", "none", "fn5"]), "member", "x", r.choice(types)) for i in range(900)]
    sites = spark.createDataFrame(rows, "site string, source_id string, file_path string, called_name string, call_form string, receiver string, receiver_type string")
    out = {x["site"]: (x["target_id"], x["n_candidates"]) for x in calls.resolve(sites, nodes).collect()}
    for site, _, _, name, _, _, kind in rows:
        have = [i for i, _, n, *_ in symbols if n == name]
        fit = [i for i in have if kind and (kind in i or name == kind)]
        assert out[site] == (fit[0] if len(fit) == 1 else have[0] if len(have) == 1 else None, len(have)), (name, kind)
    imports = [(f"src/f{a}.ts", f"src/f{b}.ts") for a in range(46) for b in r.sample(range(40), 2)]
    links = spark.createDataFrame(imports, "from_file string, to_file string")
    found = {(x["name"], x["file_path"]): x["id"] for x in heritage.find_symbols(sites.select(F.col("called_name").alias("name"), "file_path"), nodes, links).collect()}
    for _, _, path, name, *_ in rows:
        tier = lambda f: 0 if f == path else 1 if (path, f) in imports else 2  # noqa: B023, E731
        assert found[name, path] == min(((tier(s[3]), o, s[0]) for o, s in enumerate(symbols) if s[2] == name), default=(0, 0, None))[2]


def most_rows(df, metric="numOutputRows"):
    """Rows of the largest step of a plan, once it has run."""
    df.collect()

    def walk(plan):
        told = plan.metrics().get(metric)
        below = plan.children()
        return max([told.get().value() if told.isDefined() else 0, *[walk(below.apply(i)) for i in range(below.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def steps_of(spark, monkeypatch):
    """The rows of the largest step of each written table, as heritage, calls and imports write them."""
    from lodegraph.operators import imports

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen = []
    for module in (heritage, calls, imports):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: seen.append(most_rows(df)) or cut(df))
    yield seen
    spark.conf.unset("spark.sql.adaptive.enabled")


def dense(spark):
    """40 names in each of 60 files, all files importing all, but for f59, which imports the last only."""
    nodes = nodes_of(spark, [(f"Function:f{f}:n{n}", "Function", f"n{n}", f"f{f}", 1, True) for f in range(60) for n in range(40) if (f + n) % 3])
    links = spark.createDataFrame([(f"f{a}", f"f{b}") for a in range(60) for b in range(60) if a < 59 or b == 58], "from_file string, to_file string")
    return nodes, links


def test_symbols_of_names_and_links_that_are_many(spark, steps_of):
    """What is asked is not joined with a file's links, and the files of a name stand for all that link to them."""
    nodes, links = dense(spark)
    rows = [(f"n{n}", f"f{f}") for f in range(60) for n in range(40)] + [("x.n1", "f3"), ("n1", "elsewhere"), ("n1", None), ("none", "f1")]
    told = heritage.find_symbols(spark.createDataFrame(rows, "name string, file_path string"), nodes, links)
    steps_of.append(most_rows(told))
    found = {(r["name"], r["file_path"]): r["id"] for r in told.collect()}
    assert max(steps_of) < 4 * len(rows)
    assert len(found) == len(rows) and found["n0", "f0"] == "Function:f1:n0" and found["n1", "f3"] == found["x.n1", "f3"] == "Function:f3:n1"
    assert found["n2", "f0"] == "Function:f0:n2" and found["n3", "f0"] == "Function:f1:n3" and found["n1", "f59"] == "Function:f58:n1" and found["n4", "f59"] == "Function:f58:n4"
    assert found["n0", "f57"] == "Function:f1:n0" and found["n1", "f2"] == found["n1", "elsewhere"] == found["n1", None] == "Function:f0:n1" and found["none", "f1"] is None


def test_candidates_are_not_shuffled(spark, steps_of):
    """Every site and callable of its name, tiers by file and import, over more files than a row has bits; the rows told
    come from the last join."""
    nodes, links = dense(spark)
    files = [f"f{f}" for f in range(60)] + [f"g{f:04}" for f in range(600)] + [None]
    links = links.unionAll(spark.createDataFrame([(f"g{i:04}", f"f{i % 60}") for i in range(600)], links.schema))
    rows = [(f"{n}@{f}", f"n{n}", f) for f in files for n in (1, 7)] + [("none", "none", "f1")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = calls.candidates(spark.createDataFrame(rows, "site string, called_name string, file_path string"), nodes, links)
        assert most_rows(told, "shuffleRecordsWritten") < 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    have = {tuple(r) for r in links.collect()}
    symbols = [(r["id"], r["name"], r["file_path"], r["ord"]) for r in nodes.collect()]
    want = sorted((s, i, 0 if f == p else 1 if (f, p) in have else 2, o) for s, n, f in rows for i, m, p, o in symbols if m == n)
    assert sorted(tuple(r) for r in told.select("site", "target_id", "tier", "target_ord").collect()) == want and len(want) > 50_000
    assert calls.candidates(spark.createDataFrame(rows, "site string, called_name string, file_path string"), nodes).where("tier = 1").isEmpty()


def linked_at_random(spark, seed):
    """Weights both ways over five components, one of them an edge to itself, ids of many lengths."""
    r = random.Random(seed)
    links = [(f"g{g}/{r.randint(0, n)}", f"g{g}/{r.randint(0, n)}", r.choice([0.1, 0.55, 0.9, 1.0])) for g, n, m in ((0, 60, 200), (1, 12, 30), (2, 110, 130), (3, 1, 4)) for _ in range(m)] + [("self", "self", 1.0)]
    rows = spark.createDataFrame(links + [(b, a, w) for a, b, w in links], "a string, b string, w double")
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_in_a_task_and_by_rounds(spark, monkeypatch, seed):
    """A component's communities do not depend on where its rounds are worked out, nor on what ids are numbered by; in a
    task they write no table a round."""
    weights = linked_at_random(spark, seed)
    names = weights.selectExpr("a AS id").distinct().selectExpr("id", "pmod(xxhash64(id), 1000000007) AS n")
    a, b = (names.selectExpr(f"id AS {x}", f"n AS {y}") for x, y in (("a", "x"), ("b", "y")))
    by_number = weights.join(a, "a").join(b, "b").selectExpr("x AS a", "y AS b", "w")
    of = lambda df: sorted((r["node"], r["component"]) for r in df.collect())
    written, cut = [], community.cut
    monkeypatch.setattr(community, "cut", lambda df: written.append(1) or cut(df))
    want = of(community.clusters(weights, min_size=1))
    assert len(written) < 16 and ("self", "self") in want and len({c for _, c in want}) < len(want) / 2
    assert of(community.clusters(by_number, min_size=1, names=names)) == want
    assert of(community.clusters(by_number, names=names)) == [x for x in want if sum(c == x[1] for _, c in want) > 1]
    monkeypatch.setattr(community, "WHOLE", 100)
    assert of(community.clusters(weights, min_size=1)) == want
    monkeypatch.setattr(community, "AT_ONCE", 40)
    monkeypatch.setattr(community, "BUNDLE", 50)
    monkeypatch.setattr(community, "WHOLE", 1000)
    assert of(community.clusters(weights, min_size=1)) == want


def test_turns_are_those_of_spark(spark):
    import numpy as np

    rows = spark.range(50).selectExpr("xxhash64(string(id)) AS seed", "xxhash64(string(id), 3007) AS told").collect()
    assert community.turn_hash(np.array([r["seed"] for r in rows], np.int64), 3007).view(np.int64).tolist() == [r["told"] for r in rows]
