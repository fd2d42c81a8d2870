"""Inheritance: closures, common ancestors, C3 linearisation, method conflicts, clause extraction."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .imports import linked
from .iterate import cut, reach


def parents_of(edges: DataFrame) -> DataFrame:
    """``child``, ``parent``, ``ord`` of the extends edges."""
    return edges.where("kind = 'EXTENDS'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent"), "ord")


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root``, ``node``, ``depth``: each ancestor once, at its least depth. Interfaces are no ancestors."""
    up = parents_of(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return reach(up, starts, max_depth).where("depth > 0")


def descendants(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    down = parents_of(edges).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return reach(down, starts, max_depth).where("depth > 0")


def subclasses(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``child``, ``parent`` and ``is_subclass``."""
    found = ancestors(edges, pairs.select(F.col("child").alias("root")).distinct()).select(F.col("root").alias("child"), F.col("node").alias("parent"), F.lit(True).alias("_yes"))
    return pairs.join(found, ["child", "parent"], "left").select("child", "parent", F.coalesce("_yes", F.lit(False)).alias("is_subclass"))


def common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b`` and their nearest common ancestor, as seen from b, then the least id; null if there is none."""
    roots = pairs.select(F.explode(F.array("a", "b")).alias("root")).distinct()
    above = ancestors(edges, roots)
    of_a = above.select(F.col("root").alias("a"), F.col("node").alias("ancestor"))
    of_b = above.select(F.col("root").alias("b"), F.col("node").alias("ancestor"), "depth")
    found = pairs.join(of_a, "a").join(of_b, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("ancestor"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", "ancestor")


def inheritance_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``name``, ``kind`` of classes and interfaces; ends of edges that are no node join them without a name,
    as interfaces if something implements them."""
    known = nodes.where(F.col("kind").isin("Class", "Interface")).select("id", "name", F.lower("kind").alias("kind"))
    of = edges.where(F.col("kind").isin("EXTENDS", "IMPLEMENTS"))
    ends = of.select(F.col("source_id").alias("id"), F.lit(False).alias("i")).unionAll(of.select(F.col("target_id").alias("id"), (F.col("kind") == "IMPLEMENTS").alias("i")))
    ends = ends.groupBy("id").agg(F.max("i").alias("i"))
    joined = known.join(ends, "id", "full")
    return joined.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.when(F.col("i"), "interface").otherwise("class")).alias("kind"))


def merged(lists: list[list[str]]) -> list[str] | None:
    """The C3 merge of linearisations; None if they contradict each other. Takes time in proportion to their lengths."""
    left = Counter(c for x in lists for c in x[1:])  # in how many places a class stands behind others
    at = [0] * len(lists)
    out: list[str] = []
    while any(a < len(x) for a, x in zip(at, lists)):
        head = next((x[a] for a, x in zip(at, lists) if a < len(x) and not left[x[a]]), None)
        if head is None:
            return None
        out.append(head)
        for i, x in enumerate(lists):
            if at[i] < len(x) and x[at[i]] == head:
                at[i] += 1
                if at[i] < len(x):
                    left[x[at[i]]] -= 1
    return out


def linearised(node: str, above: list[list[str] | None], parents: list[str]) -> list[str] | None:
    """A class's linearisation from those of its parents, in order; None if there is none."""
    if any(x is None for x in above):
        return None
    rest = merged([*above, parents])
    return None if rest is None else [node, *rest]


def post_order(start: str, parents: dict[str, list[str]]) -> list[str]:
    """The class's ancestors, each after its own, itself last."""
    order, met, walk = [], {start}, [(start, iter(parents.get(start, [])))]
    while walk:
        node, more = walk[-1]
        child = next((p for p in more if p not in met), None)
        if child is None:
            order.append(node)
            walk.pop()
        else:
            met.add(child)
            walk.append((child, iter(parents.get(child, []))))
    return order


def linearisations(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``id``, ``linearization`` and ``consistent`` for each class of ``classes`` (column ``id``): its C3 order, and
    where there is none, as parents contradict each other or a class descends from itself, its ancestors in post-order. A
    class without parents is its own. The order of parents is that of their edges.

    Level by level from the roots: a class is worked out once, as soon as all its parents are, from their lists alone.
    Only a class without a C3 order meets the edges of all its ancestors.
    """
    up = cut(parents_of(edges).groupBy("child", "parent").agg(F.min("ord").alias("ord")))
    asked = classes.select("id").distinct()
    # what the asked classes descend from: one start that leads to all of them
    every = up.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionAll(asked.select(F.lit("").alias("src"), F.col("id").alias("dst")))
    needed = cut(reach(every, asked.sparkSession.createDataFrame([("",)], "root string")).where("depth > 0").select(F.col("node").alias("id")))
    left = cut(up.join(needed.withColumnRenamed("id", "child"), "child", "left_semi"))
    made = cut(needed.join(left.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id", F.array("id").alias("linearization")))
    new, lists = made, made

    @F.pandas_udf("array<string>")
    def work(node: pd.Series, above: pd.Series, parents: pd.Series) -> pd.Series:
        return pd.Series([linearised(n, [None if x is None else list(x) for x in a], list(p)) for n, a, p in zip(node, above, parents)])

    while not new.isEmpty():
        given = left.join(lists.select(F.col("id").alias("parent"), "linearization", F.lit(True).alias("known")), "parent", "left")
        ready = given.groupBy("child").agg(
            F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"), F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("ord", "parent", "linearization")))).alias("above"),
        ).where("n = n_known")
        new = cut(ready.select(F.col("child").alias("id"), work("child", F.col("above.linearization"), F.col("above.parent")).alias("linearization")))
        left = cut(left.join(new.select(F.col("id").alias("child")), "child", "left_anti"))
        lists = lists.unionByName(new)
    # what is left descends from itself or from such a class
    odd = lists.where("linearization is null").select("id").unionAll(left.select(F.col("child").alias("id")).distinct())
    odd = cut(odd.join(asked, "id", "left_semi"))
    told = lists.where("linearization is not null").join(asked, "id", "left_semi").withColumn("consistent", F.lit(True))
    n_odd = odd.count()
    if not n_odd:
        return told.select("id", "linearization", "consistent")
    above = reach(up.select(F.col("child").alias("src"), F.col("parent").alias("dst")), odd.select(F.col("id").alias("root"))).select("root", F.col("node").alias("child"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, dict[str, list[str]]] = {}
        for start, child, parent in frame.sort_values(["ord", "parent"])[["root", "child", "parent"]].itertuples(index=False):
            parents.setdefault(start, {}).setdefault(child, []).append(parent)
        return pd.DataFrame({"id": list(parents), "linearization": [post_order(s, p) for s, p in parents.items()], "consistent": False})

    some = F.pmod(F.xxhash64("root"), F.lit(-(-n_odd // 100)))  # about a hundred classes at once
    found = above.join(up, "child").groupBy(some).applyInPandas(walk, "id string, linearization array<string>, consistent boolean")
    return told.select("id", "linearization", "consistent").unionByName(found)


def method_conflicts(linear: DataFrame, methods: DataFrame) -> DataFrame:
    """For each class the method names that two or more classes of its linearisation define: ``id``, ``method``,
    ``sources`` (in order) and ``resolved_to``, the first. ``methods`` has ``owner`` and ``method``."""
    at = linear.select("id", F.posexplode("linearization").alias("pos", "owner")).join(methods.distinct(), "owner")
    sources = F.transform(F.array_sort(F.collect_list(F.struct("pos", "owner"))), lambda e: e["owner"])
    grouped = at.groupBy("id", "method").agg(sources.alias("sources")).where(F.size("sources") > 1)
    return grouped.withColumn("resolved_to", F.col("sources")[0])


def heritage_stats(edges: DataFrame) -> DataFrame:
    """Edges by kind."""
    return edges.where(F.col("kind").isin("EXTENDS", "IMPLEMENTS")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


def find_symbols(asked: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``asked`` (``name``, ``file_path``) with ``id``: the first symbol of that name in the same file, else in an
    imported file, else anywhere; for a dotted name that is nowhere, the same with its last part; else null.

    ``imports`` has ``from_file`` and ``to_file``. Of the files that have a name, in order of its first symbol there, each
    is the one for those importing files that have none before it, 64 of them at once: what is asked meets only these,
    and neither the files a file imports nor all those that have a name.
    """
    whole = cut(asked.select("name", "file_path").distinct())
    tries = whole.select("name", "file_path", F.lit(0).alias("try"), F.col("name").alias("wanted"))
    last = F.substring_index("name", ".", -1)
    tries = tries.unionAll(whole.where(F.col("name").contains(".")).select("name", "file_path", F.lit(1), last))
    # the first of each name, and of each name and file, before they meet what is asked: no group is joined with a group
    order = F.struct("ord", "id")
    by_file = symbols.groupBy(F.col("name").alias("wanted"), F.col("file_path").alias("in_file")).agg(F.min(order).alias("first"))
    by_name = symbols.groupBy(F.col("name").alias("wanted")).agg(F.min(order).alias("first"))
    if imports is not None:
        number = F.monotonically_increasing_id()
        by_file = cut(by_file.repartitionByRange("first").sortWithinPartitions("first").withColumn("n", number))
        names = cut(by_file.select("wanted").distinct().withColumn("k", number))
        blocks, masks = linked(imports, whole.select("file_path"))
        tried = by_file.join(names, "wanted").join(masks.withColumnRenamed("to_file", "in_file"), "in_file").select("k", "block", "n", "mask")
        earlier = F.bit_or("mask").over(Window.partitionBy("k", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(earlier, F.lit(0).cast("bigint"))))
        new = cut(tried.select("k", "block", "n", new.alias("new")).where("new <> 0"))
        new = new.join(by_file.select("n", "first"), "n").join(names, "k").select("wanted", "block", "new", "first")
        linked_to = tries.join(blocks, "file_path").join(new, ["wanted", "block"]).where(F.expr("shiftright(new, bit) & 1 = 1"))
        linked_to = cut(linked_to.select("name", "file_path", "try", F.lit(1).alias("tier"), "first"))
    found = tries.withColumn("in_file", F.col("file_path")).join(by_file, ["wanted", "in_file"]).select("name", "file_path", "try", F.lit(0).alias("tier"), "first")
    if imports is not None:
        found = found.unionByName(linked_to)
    found = found.unionByName(tries.join(by_name, "wanted").select("name", "file_path", "try", F.lit(2).alias("tier"), "first"))
    best = found.groupBy(F.col("name").alias("_name"), F.col("file_path").alias("_path")).agg(F.min(F.struct("try", "tier", "first"))["first"]["id"].alias("id"))
    return whole.join(best, (F.col("name") == F.col("_name")) & F.col("file_path").eqNullSafe(F.col("_path")), "left").select("name", "file_path", "id")


def class_clause(line: Column, language: Column) -> dict[str, Column]:
    """From a declaration, over however many lines, its ``name``, the names it ``extends`` and ``implements``
    (arrays), without what stands in brackets; bases after a colon or ``<`` are extended."""
    for inner in (r"<[^<>]*>",) * 4:  # generic parameters, from the inside
        line = F.regexp_replace(line, inner, "")
    strip = lambda names: F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\(.*|\b(?:public|protected|private|virtual)\s", ""))), lambda n: n.rlike(r"^[A-Za-z_$][\w$.\\]*$"))
    listed = lambda text: strip(F.split(text, ","))
    name = F.regexp_extract(line, r"\b(?:class|interface|trait|protocol|struct)\s+([A-Za-z_]\w*)", 1)
    python = F.regexp_extract(line, r"\bclass\s+\w+\s*\(([^)]*)\)", 1)
    extends = F.regexp_extract(line, r"\bextends\s+([^{]+?)(?:\bimplements\b|\{|$)", 1)
    implements = F.regexp_extract(line, r"\bimplements\s+([^{]+?)(?:\{|$)", 1)
    bases = F.regexp_extract(F.regexp_replace(line, r"\([^()]*\)", ""), r"\b(?:class|interface|protocol|struct|record|object)\s+[\w$]+\s*:\s*([^{]+?)(?:\bwhere\b|\{|$)", 1)
    base = F.regexp_extract(line, r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)", 1)
    nothing = F.array().cast("array<string>")
    return {
        "name": F.when(name != "", name),
        "extends": F.when((language == "python") & (python != ""), listed(python)).when((language == "ruby") & (base != ""), F.array(F.replace(base, F.lit("::"), F.lit("."))))
        .when(language.isin("csharp", "kotlin", "swift", "cpp") & (bases != ""), listed(bases)).when(extends != "", listed(extends)).otherwise(nothing),
        "implements": F.when(implements != "", listed(implements)).otherwise(nothing),
    }


def heritage_edges(clauses: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges from ``clauses`` (``id``, ``file_path``, ``is_interface``, ``extends``,
    ``implements``). A class extends with confidence 1, an interface with 0.95; implementing has 0.95. Unknown parents
    give no edge."""
    kinds = []
    for kind, column in (("EXTENDS", "extends"), ("IMPLEMENTS", "implements")):
        sure = F.when((F.lit(kind) == "EXTENDS") & ~F.coalesce("is_interface", F.lit(False)), 1.0).otherwise(0.95)
        kinds.append(clauses.select("id", "file_path", F.posexplode(column).alias("pos", "name"), F.lit(kind).alias("kind"), sure.alias("confidence")))
    asked = kinds[0].unionAll(kinds[1])
    targets = find_symbols(asked, symbols.where(F.col("kind").isin("Class", "Interface")), imports)
    told = asked.join(targets.withColumnRenamed("id", "target_id"), ["name", "file_path"])
    made = told.where("target_id is not null").select(
        F.concat("id", F.lit("->"), "target_id", F.lit(":"), "kind").alias("id"), F.col("id").alias("source_id"), "target_id", "kind", "confidence", F.col("pos").cast("long").alias("ord"),
    )
    return made.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_n = 1").drop("_n")
