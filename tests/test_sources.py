"""Sources, languages, imports, extraction, ingestion, tools, storage and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodegraph.graph import Graph
from lodegraph import commands
from lodegraph.operators import community, extract, heritage, imports, search, types
from lodegraph.plans import ingest
from lodegraph.sources import ignore, language, store, walk
from lodegraph.streaming import incremental
from lodegraph.tools import Engine


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {"file1.js": "function a() {}\n", "file2.ts": "export const b = (x) => x\n", "subdir/file3.py": "def c():\n    return 1\n", "subdir/file4.txt": "text", ".gitignore": "*.txt\n# no\n", "node_modules/x.js": "x", "image.js": "\0\1"}
    for name, content in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(content)
    return str(root)


def test_walk(spark, tree):
    found = {r["path"]: r["status"] for r in walk.walk(spark, tree).collect()}
    assert found == {"file1.js": "read", "file2.ts": "read", "subdir/file3.py": "read", ".gitignore": "read", "image.js": "binary"}
    assert {r["path"] for r in walk.walk(spark, tree, walk.WalkOptions(max_depth=0, use_gitignore=False, read_content=False)).collect()} == {"file1.js", "file2.ts", ".gitignore", "image.js"}
    small = walk.walk(spark, tree, walk.WalkOptions(max_file_size=10))
    assert small.where("path = 'file1.js'").first()["status"] == "too_large" and small.where("path = 'file1.js'").first()["content"] is None
    told = walk.walk_stats(walk.walk(spark, tree)).first()
    assert (told["total_files"], told["skipped_files"]) == (4, 1)


def test_ignore_patterns():
    rules = ignore.IgnorePatterns(["*.log", "temp/", "!keep.log", "/only_root", "a/**/z"])
    told = {p: rules.ignores_path(p) for p in ("x.log", "d/x.log", "keep.log", "temp/x", "src/x.ts", "node_modules/y", "only_root", "d/only_root", "a/b/c/z", "a/z", "x.png", "distant")}
    assert told == {"x.log": True, "d/x.log": True, "keep.log": False, "temp/x": True, "src/x.ts": False, "node_modules/y": True, "only_root": True, "d/only_root": False, "a/b/c/z": True, "a/z": True, "x.png": True, "distant": False}


def test_binary(spark):
    rows = [(b"plain text\n",), (b"a\0b",), (bytes([1, 2, 3] * 50),), (b"\xff\xd8\xffrest of it is printable text" * 3,), (b"",), (None,)]
    told = [r[0] for r in spark.createDataFrame(rows, "b binary").select(ignore.is_binary(F.col("b"))).collect()]
    assert told == [False, True, True, True, False, False]


def test_languages(spark):
    rows = [("index.ts", None), ("script.py", None), ("run", "#!/usr/bin/env python3\n"), ("x", "#!/usr/bin/ruby\n"), ("page", "<?php echo 1;"), ("Dockerfile", None), ("a/Cargo.toml", None), ("go.mod", None), ("unknown.xyz", "nothing")]
    out = [r[0] for r in spark.createDataFrame(rows, "p string, c string").select(language.detect(F.col("p"), F.col("c"))).collect()]
    assert [o and (o["language"], o["detected_by"]) for o in out] == [("typescript", "extension"), ("python", "extension"), ("python", "shebang"), ("ruby", "shebang"), ("php", "content"), ("javascript", "filename"), ("rust", "filename"), ("go", "filename"), None]
    assert language.registry(spark).count() == 12 and "typescript" in language.supported()
    shown = spark.createDataFrame([("go", "PublicFunc"), ("go", "privateFunc"), ("python", "public_func"), ("python", "_private_func")], "l string, n string")
    assert [r[0] for r in shown.select(language.is_exported(F.lit(""), F.col("n"), F.col("l"))).collect()] == [True, False, True, False]


def resolved(spark, files, asked, aliases=None):
    listed = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, ord bigint")
    made = spark.createDataFrame(asked, "import_path string, file_path string, language string")
    return {r["import_path"]: (r["resolved_path"], r["method"]) for r in imports.resolve_imports(made, listed, aliases).collect()}


def test_imports(spark):
    files = ["src/index.ts", "src/utils/helpers.ts", "src/components/Button.tsx", "lib/helpers.js", "package.json"]
    out = resolved(spark, files, [("./utils/helpers", "src/index.ts", "typescript"), ("./missing", "src/index.ts", "typescript"), ("@/utils/helpers", "src/index.ts", "typescript"), ("utils/helpers", "x.ts", "typescript")], [("@", "src")])
    assert out == {"./utils/helpers": ("src/utils/helpers.ts", "relative"), "./missing": (None, "unresolved"), "@/utils/helpers": ("src/utils/helpers", "path-alias"), "utils/helpers": ("src/utils/helpers.ts", "suffix")}
    out = resolved(spark, ["app/models/user.py", "app/__init__.py", "app/services/auth.py"], [("..models.user", "app/services/auth.py", "python"), ("app", "x.py", "python"), (".auth", "app/services/x.py", "python")])
    assert out == {"..models.user": ("app/models/user.py", "relative"), "app": ("app/__init__.py", "absolute"), ".auth": ("app/services/auth.py", "relative")}
    assert resolved(spark, ["cmd/main.go", "internal/auth/handler.go"], [("internal/auth", "cmd/main.go", "go")])["internal/auth"] == ("internal/auth/handler.go", "directory")
    out = resolved(spark, ["src/main.rs", "src/models/user.rs", "src/models/mod.rs"], [("crate::models::user", "src/main.rs", "rust"), ("crate::models", "src/main.rs", "rust"), ("super::models::user", "src/api/x.rs", "rust")])
    assert out["crate::models::user"] == ("src/models/user.rs", "crate") and out["crate::models"] == ("src/models/mod.rs", "crate")


def test_extraction():
    js = "export function greet(name) {\n  return name;\n}\nclass User {\n  constructor(a) {\n  }\n  save() {\n    db.put(this, 1);\n  }\n}\nconst add = (a, b) => a + b;\n"
    assert [(k, n) for k, n, *_ in extract.scan_symbols(js, "javascript")] == [("Function", "greet"), ("Class", "User"), ("Constructor", "constructor"), ("Method", "save"), ("Function", "add")]
    assert [r[2:4] for r in extract.scan_symbols(js, "javascript")][:2] == [(1, 3), (4, 10)]
    assert [(k, n) for k, n, *_ in extract.scan_symbols("class A(B):\n    def m(self):\n        pass\ndef f(x, y):\n    pass\n", "python")] == [("Class", "A"), ("Method", "m"), ("Function", "f")]
    assert [(k, n) for k, n, *_ in extract.scan_symbols("type T struct {\n}\nfunc (t *T) Run() {\n}\nfunc main() {\n}\n", "go")] == [("Class", "T"), ("Method", "Run"), ("Function", "main")]
    assert [(k, n) for k, n, *_ in extract.scan_symbols("pub struct P;\ntrait Q {}\nimpl P {\n    pub fn go(&self) {}\n}\nfn main() {}\n", "rust")] == [("Class", "P"), ("Interface", "Q"), ("Method", "go"), ("Function", "main")]
    assert extract.scan_calls(js, "javascript") == [(8, 5, "db.put(this, 1)", "put", 2)]
    assert [i for i, _ in extract.scan_imports("import x from './a'\nimport 'b'\nconst c = require('d')\n", "javascript")] == ["./a", "b", "d"]


FILES = [
    ("app/base.py", "class Base:\n    def save(self):\n        pass\n"),
    ("app/user.py", "from .base import Base\n\nclass User(Base):\n    def rename(self, n):\n        self.store(n)\n    def store(self, n):\n        write_all(n)\n"),
    ("app/main.py", "from .user import User\n\ndef main():\n    handle_all()\n\ndef handle_all():\n    write_all(1)\n\ndef write_all(x):\n    return x\n"),
]


@pytest.fixture(scope="module")
def built(spark):
    return ingest.build(spark.createDataFrame(FILES, "path string, content string"))


def test_ingestion(built):
    edges = {(r["kind"], r["source_id"], r["target_id"]) for r in built.edges.collect()}
    assert ("EXTENDS", "Class:app/user.py:User", "Class:app/base.py:Base") in edges
    assert ("IMPORTS", "File:app/user.py", "File:app/base.py") in edges and ("CONTAINS", "Folder:app", "File:app/main.py") in edges
    assert ("CALLS", "Function:app/main.py:main", "Function:app/main.py:handle_all") in edges
    assert ("CALLS", "Method:app/user.py:store", "Function:app/main.py:write_all") in edges
    assert built.dangling().isEmpty()
    whole, members, flows = ingest.analyse(built)
    assert flows.count() >= 1 and whole.nodes.where("kind = 'Process'").count() == flows.count()
    told = ingest.report(whole, members, flows, time.time())
    assert told["files"] == 3 and store.skills_report(members, members.select("component", F.lit("L").alias("label")).distinct(), flows).count() > 2


def test_tools(built):
    engine = Engine(built, "demo")
    assert [r["name"] for r in engine.call("query", query="main", kind="Function").collect()] and engine.call("impact", target="write_all", direction="upstream").where("node = 'Function:app/main.py:main'").first()["depth"] == 2
    assert engine.call("find_path", source="main", target="write_all").first()["length"] == 2 and engine.call("list_repos").first()["name"] == "demo"
    assert engine.call("context", symbol="handle_all").where("role = 'caller'").count() == 1 and engine.call("community").count() == 0
    assert "languages: python" in engine.resource("repo/demo/context")
    with pytest.raises(KeyError):
        engine.call("nothing")


def test_storage(spark, built, tmp_path):
    store.save(built, f"{tmp_path}/g")
    again = store.load(spark, f"{tmp_path}/g")
    assert again.diff(built).isEmpty() and store.load_or_empty(spark, f"{tmp_path}/none").nodes.isEmpty()
    store.save_json(built, f"{tmp_path}/j")
    assert store.load_json(spark, f"{tmp_path}/j").diff(built).isEmpty()
    (tmp_path / "d.json").write_text(json.dumps({"version": "1", "nodes": [{"id": "a", "kind": "File", "filePath": "x"}, {"id": "a", "kind": "File"}], "edges": [{"id": "e", "sourceId": "a", "targetId": "a", "kind": "CALLS", "confidence": 1}]}))
    assert store.load_document(spark, f"{tmp_path}/d.json").nodes.first()["file_path"] == "x"
    for i in range(4):
        store.backup(built, f"{tmp_path}/b", f"b{i}", keep=2)
    assert len(store.backups(spark, f"{tmp_path}/b")) == 2 and store.latest_backup(spark, f"{tmp_path}/b").endswith("b3")
    registry = f"{tmp_path}/registry"
    store.write_registry(spark, registry, [{"path": "p", "index": f"{tmp_path}/g"}])
    store.write_registry(spark, registry, [{"path": "p", "index": f"{tmp_path}/g", "n": 2}, {"path": "q", "index": f"{tmp_path}/none"}])
    assert len(store.read_registry(spark, registry)) == 2 and store.clean(spark, registry, "p") == [f"{tmp_path}/g"] and len(store.read_registry(spark, registry)) == 1


def test_trees(spark):
    rows = [("r", None, "program", 0, 0, 900, 0, None, None), ("f", "r", "function", 1, 0, 500, 0, None, "body"), ("c", "f", "call", 2, 2, 2, 9, "g(x)", "value"), ("d", "f", "call", 300, 0, 300, 5, "h()", "value")]
    rows += [("o", None, "program", 0, 0, 5, 0, None, None)]
    rows = [("b.ts" if r[0] == "o" else "a.ts", *r) for r in rows]
    tree = spark.createDataFrame(rows, "file_path string, node_id string, parent_id string, type string, start_row int, start_col int, end_row int, end_col int, text string, field string")
    assert {r["node_id"]: r["depth"] for r in extract.tree_depths(tree).collect()} == {"r": 0, "f": 1, "c": 2, "d": 2, "o": 0}
    points = spark.createDataFrame([("a.ts", 2, 4), ("a.ts", 3, 0), ("a.ts", 800, 0), ("a.ts", 300, 1), ("b.ts", 2, 4), ("c.ts", 2, 4)], "file_path string, row int, col int")
    assert {tuple(r) for r in extract.nodes_at(tree, points).collect()} == {("a.ts", 2, 4, "c"), ("a.ts", 3, 0, "f"), ("a.ts", 800, 0, "r"), ("a.ts", 300, 1, "d"), ("b.ts", 2, 4, "o")}
    mine = tree.where("file_path = 'a.ts'")
    assert [r["node_id"] for r in extract.nodes_of_type(mine, "call").collect()] == ["c", "d"]
    pairs = spark.createDataFrame([("c", "r"), ("r", "c"), ("c", "c"), ("c", "o")], "node string, ancestor string")
    assert {(r["node"], r["ancestor"]): r["is_descendant"] for r in extract.descends(tree, pairs).collect()} == {("c", "r"): True, ("r", "c"): False, ("c", "c"): False, ("c", "o"): False}
    assert [tuple(r) for r in extract.children_by_field(tree, "value").collect()] == [("f", "c")]
    assert [r["line"] for r in extract.serialise(mine).collect()] == ["program", "  function", '    call "g(x)"', '    call "h()"']
    assert tuple(tree.where("node_id = 'c'").select(extract.node_range(F.col("start_row"), F.col("start_col"), F.col("end_row"), F.col("end_col")).alias("r")).first()["r"]) == (3, 2, 3, 9)
    deep = spark.createDataFrame([("a.ts", str(i), str(i - 1) if i else None) for i in range(60)], "file_path string, node_id string, parent_id string")
    assert extract.tree_depths(deep).agg(F.max("depth")).first()[0] == 59


def test_many_queries(spark):
    r = random.Random(2)
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(600)], "doc bigint, vector array<double>")
    queries = vectors.withColumnRenamed("doc", "query")
    whole = search.nearest(vectors, queries, 3)
    assert whole.count() == 1800 and whole.where("rank = 1 and query = doc").count() == 600
    parts = search.nearest(vectors, queries, 3, block=50, at_once=3)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert search.nearest(vectors, queries.limit(0), 3).count() == 0


def test_hidden_files_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "BATCH", 100)
    for i in range(7):
        (tmp_path / f"_h{i}.py").write_text("x" * 60)
    assert walk.walk(spark, str(tmp_path)).where("status = 'read' and length(content) = 60").count() == 7


def test_search(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "red red blue"), (3, "")], "doc bigint, text string")
    best = search.bm25(docs, spark.createDataFrame([(7, "Red!")], "query bigint, text string")).orderBy("rank").collect()
    assert [r["doc"] for r in best] == [2, 1]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "doc bigint, vector array<float>")
    near = search.nearest(vectors, spark.createDataFrame([(5, [2.0, 0.1])], "query bigint, vector array<float>"), 2)
    assert [r["doc"] for r in near.orderBy("rank").collect()] == [1, 3]
    assert search.classify(docs.select("text"), lambda: lambda texts: [[float(len(t))] for t in texts]).agg(F.sum(F.col("scores")[0])).first()[0] == 21.0


def test_changes_as_a_stream(spark, built, tmp_path):
    rows = [(0, "upsert", "node", "n1", json.dumps({"id": "n1", "kind": "File", "name": "a"})), (1, "upsert", "node", "n1", json.dumps({"id": "n1", "kind": "File", "name": "b"})), (2, "upsert", "node", "n2", json.dumps({"id": "n2", "kind": "File"})), (3, "remove", "node", "n2", None)]
    changes = spark.createDataFrame(rows, "seq bigint, op string, entity string, id string, body string")
    changes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    incremental.apply_changes(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    made = store.load(spark, f"{tmp_path}/out/v0")
    assert [(r["id"], r["name"]) for r in made.nodes.collect()] == [("n1", "b")]
    assert isinstance(made, Graph)


SCRIPT = """import {
  a,
  b,
} from './x'
// import q from 'no'
export * from "./y"
export class Repo<T extends Base>
  extends Store<Map<string, T>>
  implements Closeable, Flushable {
  async find(
    id: string,
    opts: { deep: boolean },
  ): Promise<{ a: number }> {
    if (x(
       1)) {
    }
    return this.load(parse(id, "a,b(c)"), () => 1).then(f);
  }
}
"""


def test_declarations_and_calls_over_lines():
    found = extract.scan_symbols(SCRIPT, "typescript")
    assert [r[:4] + r[5:6] + r[7:] for r in found] == [("Class", "Repo", 7, 19, -1, None), ("Method", "find", 10, 18, 0, 2)]
    assert [(r[0], r[3], r[4]) for r in extract.scan_calls(SCRIPT, "typescript")] == [(14, "x", 1), (17, "load", 2), (17, "parse", 2), (17, "then", 1)]
    assert extract.scan_imports(SCRIPT, "typescript") == [("./x", 1), ("./y", 6)]
    python = 'import os, sys as s\nclass A(\n    B,\n):\n    """def no(): f(x)"""\n    def m(\n        self,\n        x=g(1),\n    ):\n        return h(i(x))  # j(x)\n'
    assert [r[:2] + r[7:] for r in extract.scan_symbols(python, "python")] == [("Class", "A", 1), ("Method", "m", 2)]
    assert [r[3] for r in extract.scan_calls(python, "python")] == ["g", "h", "i"] and extract.scan_imports(python, "python") == [("os", 1), ("sys", 1)]
    braces = extract.scan_symbols("pub struct P;\nimpl P {\n    pub fn go<'a>(&self, x: &'a str) -> u8 {\n        P::new(x)\n    }\n}\n", "rust")
    assert [r[:4] + r[5:6] for r in braces] == [("Class", "P", 1, 1, -1), ("Method", "go", 3, 5, -1)]
    assert extract.scan_symbols("", "python") == extract.scan_calls("", "go") == extract.scan_imports("", "javascript") == []


@pytest.mark.parametrize("text", ["foo(\n" * 60_000, "a.b()" + ".c(1)" * 60_000, "f(" * 100_000, "'" * 200_000, "import {" + "a, " * 60_000, "import a\n" * 60_000, "a." * 100_000, "import" + "\n" * 200_000, "a = " * 60_000, "class A {\n x() {\n" * 10_000])
def test_scans_are_linear(text):
    began = time.time()
    for scan in (extract.scan_symbols, extract.scan_calls, extract.scan_imports, types.scan_bindings, types.scan_members):
        scan(text, "typescript")
    assert time.time() - began < 20


def test_clauses(spark):
    rows = [("export class Repo<T extends Base> extends Store<Map<string, T>> implements Closeable, Flushable {", "typescript"), ("class A(B, c.D):", "python"), ("class A : Base(x), I {", "kotlin"), ("class A : public B, private C {", "cpp"), ("class A < M::B", "ruby"), ("class A {", "java")]
    made = spark.createDataFrame(rows, "line string, language string")
    clause = heritage.class_clause(F.col("line"), F.col("language"))
    out = [(r["e"], r["i"]) for r in made.select(clause["extends"].alias("e"), clause["implements"].alias("i")).collect()]
    assert out == [(["Store"], ["Closeable", "Flushable"]), (["B", "c.D"], []), (["Base", "I"], []), (["B", "C"], []), (["M.B"], []), ([], [])]


TYPED = [
    ("a.ts", "export class City {\n  save(): void {}\n}\nexport class Address {\n  getCity(): City { return new City() }\n}\nexport class User {\n  private address: Address;\n}\nexport function getUser(): User { return load() }\nexport class Other {\n  save() {}\n}\n"),
    ("b.ts", "function main() {\n  const user = getUser()\n  const addr = user.address\n  const city = addr.getCity()\n  let again = city\n  again.save()\n}\n"),
]


def test_types_propagate(spark):
    files = spark.createDataFrame([(p, c, "typescript") for p, c in TYPED], "path string, content string, language string")
    env = {(r["file_path"], r["var"]): r["type"] for r in types.type_env(files).collect()}
    assert {v: t for (p, v), t in env.items() if p == "b.ts"} == {"user": "User", "addr": "Address", "city": "City", "again": "City"}
    graph = ingest.build(files.select("path", "content"))
    calls = {(r["source_id"], r["target_id"]) for r in graph.edges.where("kind = 'CALLS'").collect()}
    assert ("Function:b.ts:main", "Function:a.ts:getUser") in calls
    schema = "file_path string, ord bigint, var string, how string, base string, member string, type string"
    chain = [("f", 0, "v0", "declared", None, None, "T")] + [("f", i, f"v{i}", "alias", f"v{i - 1}", None, None) for i in range(1, 40)] + [("f", 99, "x", "alias", "y", None, None), ("f", 99, "y", "alias", "x", None, None), (None, 0, None, "alias", None, None, None)]
    none = spark.createDataFrame([], "owner string, member string, type string")
    assert types.propagate(spark.createDataFrame(chain, schema), none).where("type = 'T'").count() == 40
    assert types.propagate(spark.createDataFrame([], schema), none).count() == 0
    known = spark.createDataFrame([("A", "m", "X"), ("B", "m", "Y"), ("B", "k", "Z")], "owner string, member string, type string")
    above = spark.createDataFrame([("A", "B", 1)], "name string, above string, distance int")
    assert {tuple(r) for r in types.inherited(known, above).where("owner = 'A'").collect()} == {("A", "m", "X"), ("A", "k", "Z")}


def test_hits_by_process(spark):
    flows = spark.createDataFrame([("p1", "L", "intra_community", 3, ["a", "b", "a"]), ("p2", "M", "cross_community", 1, ["b"])], "id string, label string, process_type string, step_count int, trace array<string>")
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (1, "z", 9.0)], "query bigint, doc string, score double")
    found = {(r["process"], r["process_rank"], r["doc"], r["step"]) for r in search.by_process(hits, flows).collect()}
    assert found == {("p1", 1, "a", 1), ("p1", 1, "b", 2), ("p2", 2, "b", 1), (None, 3, "z", None)}
    assert search.by_process(hits, flows, 1).count() == 2 and search.by_process(hits, flows.limit(0)).count() == 3


def test_links_are_left_out(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "d" / "a.py")
    (tmp_path / "e").symlink_to(tmp_path / "d")
    paths = lambda **options: {r["path"] for r in walk.walk(spark, str(tmp_path), walk.WalkOptions(**options)).collect()}
    assert paths() == {"d/a.py"} and paths(follow_symlinks=True) == {"d/a.py", "link.py"}


def test_packages(spark):
    files = [("node_modules/x/package.json", '{"main": "./lib/x.js"}'), ("node_modules/x/lib/x.js", ""), ("node_modules/y/index.js", ""), ("node_modules/y/package.json", '{"main": "gone.js"}'), ("node_modules/z/other.js", "")]
    known = imports.packages_of(spark.createDataFrame(files, "path string, content string"))
    assert {tuple(r) for r in known.collect()} == {("x", "lib/x.js"), ("y", "index.js"), ("z", "")}
    asked = spark.createDataFrame([("x", "src/a.ts", "typescript"), ("z/deep", "src/a.ts", "typescript"), ("w", "src/a.ts", "typescript")], "import_path string, file_path string, language string")
    listed = spark.createDataFrame([("src/a.ts", 0)], "path string, ord bigint")
    assert {r["import_path"]: (r["resolved_path"], r["method"]) for r in imports.resolve_imports(asked, listed, None, known).collect()} == {"x": ("node_modules/x/lib/x.js", "package"), "z/deep": ("node_modules/z/deep", "package"), "w": (None, "unresolved")}


def test_commands(spark, tree, tmp_path):
    home = str(tmp_path / "home")
    assert commands.status(spark, tree, home) is None and commands.list_repositories(spark, home).count() == 0
    assert commands.respond(spark, tree, home, "/api/stats")[0] == 500 and commands.respond(spark, tree, home, "/nothing")[0] == 404
    made = commands.analyze(spark, tree, home, skills=True)
    assert made["fresh"] and made["version"] is None and made["stats"]["nodes"] > 4
    assert commands.respond(spark, tree, home, "/api/stats") == (200, made["stats"]) and commands.respond(spark, tree, home, "/health")[0] == 200
    assert commands.list_repositories(spark, home).first()["nodes"] == made["stats"]["nodes"]
    assert commands.open_index(spark, tree, home).call("list_repos").first()["node_count"] == made["stats"]["nodes"]
    assert commands.status(spark, tree, home)["up_to_date"] is False
    assert commands.clean(spark, home, tree) == [made["index"]] and commands.status(spark, tree, home) is None


def test_current_version(spark, tmp_path):
    git = tmp_path / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert commands.current_version(spark, str(tmp_path)) is None
    (git / "packed-refs").write_text("# pack-refs\nabc refs/heads/main\n")
    assert commands.current_version(spark, str(tmp_path)) == "abc"
    (git / "refs" / "heads" / "main").write_text("def\n")
    assert commands.current_version(spark, str(tmp_path)) == "def"


def test_clusters_settle(spark):
    size = 5
    rows = [(b * size + i, b * size + j) for b in range(8) for i in range(size) for j in range(size) if i < j] + [(b * size, (b + 1) * size) for b in range(7)]
    both = [(str(a), str(b), 1.0) for a, b in rows] + [(str(b), str(a), 1.0) for a, b in rows]
    found = community.clusters(spark.createDataFrame(both, "a string, b string, w double"))
    groups: dict[str, set[int]] = {}
    for r in found.collect():
        groups.setdefault(r["component"], set()).add(int(r["node"]) // size)
    assert found.count() == 40 and max(map(len, groups.values())) <= 2


def test_inheritance_bit_by_bit(spark):
    files = lambda *rows: spark.createDataFrame([(p, c, "python") for p, c in rows], "path string, content string, language string")
    with pytest.raises(ValueError):
        ingest.Heritage().edges()
    made = ingest.Heritage().add_files(files(("c.py", "class C(A,\n        B):\n    pass\n")))
    assert made.edges().count() == 0
    made.add_files(files(("a.py", "class A:\n    pass\n"), ("b.py", "class B(A0):\n    pass\n")))
    made.add_symbols(spark.createDataFrame([("Class:x.py:A0", "Class", "A0", "x.py", 0)], "id string, kind string, name string, file_path string, ord int"))
    made.add_imports(spark.createDataFrame([("c.py", "a.py")], "from_file string, to_file string"))
    assert {(r["source_id"], r["target_id"]) for r in made.edges().collect()} == {("Class:c.py:C", "Class:a.py:A"), ("Class:c.py:C", "Class:b.py:B"), ("Class:b.py:B", "Class:x.py:A0")}
    lists = {r["id"]: r["linearization"] for r in made.linearisations().collect()}
    assert lists["Class:c.py:C"] == ["Class:c.py:C", "Class:a.py:A", "Class:b.py:B", "Class:x.py:A0"]
    nodes, edges = made.graph()
    assert nodes.count() == 4 and edges.count() == 3 and made.stats().first()["n"] == 3
