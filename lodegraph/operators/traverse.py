"""Traversals: hops, impact, context, paths."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import along, cut, dealt, flag, laid, reach, settings, stepped, steps


def khop(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both", include_start: bool = False) -> DataFrame:
    """``root``, ``node``, ``depth`` of what lies 1 to ``hops`` hops away, each at its least depth."""
    found = reach(steps(edges, direction), starts, hops)
    return found if include_start else found.where("depth > 0")


def khop_exclusive(edges: DataFrame, starts: DataFrame, hops: int, include_start: bool = False) -> DataFrame:
    """The undirected variant whose limit is one hop less than it says: ``hops - 1`` hops."""
    return khop(edges, starts, max(0, hops - 1), "both", include_start)


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 5, strict_compat: bool = False, names: DataFrame | None = None, by_block: bool = False) -> DataFrame:
    """What a change of each start reaches, over all kinds of edges, File nodes neither reported nor passed.

    ``upstream`` follows edges backwards, ``both`` either way - with ``strict_compat`` it means upstream. With ``names``
    ids of nodes, edges and starts are the numbers of these, and what is told are ids.
    """
    way = {"downstream": "out", "upstream": "in", "both": "in" if strict_compat else "both"}[direction]
    passed = nodes.where(~F.col("kind").eqNullSafe("File")).select(F.col("id").alias("dst"))
    pairs = steps(edges, way).join(passed, "dst", "left_semi")
    return reach(pairs, starts, max_depth, names, by_block).where("depth > 0")


def by_depth(reached: DataFrame) -> DataFrame:
    """For each root and depth how many nodes, and which, in order of id. A column ``block`` says which rows lie together."""
    keys = ["root", "depth", *({"block"} & set(reached.columns))]
    return reached.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node")).alias("nodes")).drop("block")


def context(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """Callers and callees to ``depth`` over all kinds of edges, File nodes left out, one row for each edge that leads
    to a node at its least depth, and each start's parents, children and interfaces one step away.

    Columns: ``root``, ``role``, ``node``, ``via`` (the edge's kind), ``depth``. Nodes are expanded once, from their least
    depth.
    """
    plain = nodes.where(~F.col("kind").eqNullSafe("File")).select(F.col("id").alias("node"))
    out = None
    for role, way in (("caller", "in"), ("callee", "out")):
        a, b = ("target_id", "source_id") if way == "in" else ("source_id", "target_id")
        kinds = edges.select(F.col(a).alias("src"), F.col(b).alias("node"), F.col("kind").alias("via")).join(plain, "node", "left_semi")
        reached = reach(kinds.select("src", F.col("node").alias("dst")), starts, depth)
        front = reached.where(F.col("depth") < depth).select("root", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
        rows = front.join(kinds, "src").select("root", F.lit(role).alias("role"), "node", "via", "depth")
        out = rows if out is None else out.unionByName(rows)
    for role, kind, a, b in (("parent", "EXTENDS", "source_id", "target_id"), ("child", "EXTENDS", "target_id", "source_id"), ("interface", "IMPLEMENTS", "source_id", "target_id")):
        one = edges.where(F.col("kind") == kind).select(F.col(a).alias("root"), F.lit(role).alias("role"), F.col(b).alias("node"), F.lit(kind).alias("via"), F.lit(1).alias("depth"))
        out = out.unionByName(one.join(starts, "root", "left_semi"))
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame, directed: bool = True, max_depth: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """``pairs`` (``src``, ``dst``) with ``length`` (edges, -1 if there is none, or none within ``max_depth``
    where that is given) and ``path`` (node ids with both ends; empty if there is none). From a node to itself the length
    is 0. With ``names`` (``id``, ``n``) edges hold numbers, and ``pairs`` and what is told are ids.

    Of several shortest paths the one with the smallest sequence of ids. Sources and targets are followed from both ends,
    64 of them a row, always from the end with fewer rows: a pair is settled in the first round in which the nodes a step
    beyond one end's last level are in the other's, and an end without an open pair, or without new nodes, is followed no
    further. Nodes where ends meet lead back to those on shortest paths before them, and each pair walks from its source
    to the smallest of the next nodes of these, and then of the target's levels. So no node's distance is worked out for
    an end that has no use of it.
    """
    by_number, none = names is not None, F.lit(0).cast("bigint")
    asked = pairs.select("src", "dst").distinct()
    if names is None:
        asked = cut(asked.select("src", "dst", F.col("src").alias("at"), F.col("dst").alias("to")))
    else:
        a, b = (names.select(F.col("id").alias(x), F.col("n").alias(y)) for x, y in (("src", "at"), ("dst", "to")))
        asked = cut(asked.join(a, "src").join(b, "dst").select("src", "dst", "at", "to"))
    parted = asked.where("at <> to")
    ends = [dealt(parted.select(F.col(name).alias("root")).distinct()).toDF(name, block, bit) for name, block, bit in (("at", "sb", "sbit"), ("to", "tb", "tbit"))]
    live = cut(parted.join(ends[0], "at").join(ends[1], "to"))
    ways = steps(edges, "out" if directed else "both")
    out = laid(ways if by_number else ways.distinct(), by_number)
    held = [out, laid(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")), by_number) if directed else out]
    first = [e.toDF("node", "block", "bit").groupBy("node", "block").agg(F.bit_or(flag()).alias("new")) for e in ends]
    levels = [[cut(level.withColumn("seen", F.col("new")))] for level in first]
    counts = [level[0].count() for level in levels]
    settled: list[tuple[int, int, DataFrame]] = []  # the length, how far from the source ends met, and where for which pair
    own = lambda bits, bit: F.expr(f"shiftright({bits}, {bit}) & 1 = 1")
    with settings(edges.sparkSession, spark_sql_requireAllClusterKeysForCoPartition="false", spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        while not live.isEmpty() and (max_depth is None or sum(map(len, levels)) - 1 <= max_depth):
            side = int(len(levels[1]) == 1 or counts[1] <= counts[0])  # targets that nothing leads to go first
            (block, bit), (far, far_bit) = (("sb", "sbit"), ("tb", "tbit"))[:: -1 if side else 1]

            def asking(rows: DataFrame, *bits: str) -> DataFrame:
                """The rows, with only the bits of ends with an open pair."""
                mask = live.groupBy(F.col(block).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(bit))).alias("mask"))
                return rows.join(mask, "block").select("node", "block", *[F.col(b).bitwiseAND(F.col("mask")).alias(b) for b in bits])

            level, other = levels[side][-1], levels[1 - side][-1].where("new <> 0").select("node", F.col("block").alias(far), F.col("new").alias("theirs"))
            other = other.join(live.select(F.col(block).alias("block"), far).distinct(), far)
            front = asking(level.where("new <> 0"), "new").where("new <> 0")
            near = stepped(front, held[side], by_number).join(other, ["node", "block"])
            bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("found"), i).bitwiseAND(1) == 1)
            near = near.select("node", F.col("block").alias(block), far, "theirs", F.explode(bits).alias(bit))
            there = cut(near.join(live, [block, far, bit]).where(own("theirs", far_bit)).select(*live.columns, "node"))
            length, far_from_source = sum(map(len, levels)) - 1, len(levels[0]) - side
            settled.append((length, far_from_source, there))
            live = cut(live.join(there.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(live.columns))
            if live.isEmpty():
                break
            found = stepped(asking(level.where("new <> 0"), "new").where("new <> 0"), held[side], by_number)
            both = found.select("node", "block", none.alias("seen"), "found").unionAll(asking(level, "seen").select("node", "block", "seen", none))
            both = both.groupBy("node", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("found").alias("found"))
            seen, now = F.col("seen"), F.col("found")
            levels[side].append(cut(both.select("node", "block", now.bitwiseAND(F.bitwise_not(seen)).alias("new"), seen.bitwiseOR(now).alias("seen")).where("seen <> 0")))
            new = levels[side][-1].where("new <> 0")
            counts[side] = new.count()
            going = new.groupBy(F.col("block").alias(block)).agg(F.bit_or("new").alias("going"))
            live = cut(live.join(going, block).where(own("going", bit)).select(live.columns))
        keys = ["src", "dst", "sb", "sbit"]
        between: dict[int, DataFrame] = {}  # nodes on shortest paths so far from the source, up to where ends met
        for far in range(max((p for _, p, _ in settled), default=0), 0, -1):
            here = [there.select(*keys, "node") for _, p, there in settled if p == far]
            if far + 1 in between:
                before = along(between[far + 1].withColumnRenamed("node", "at"), held[1], by_number).drop("at").withColumnRenamed("next", "node")
                known = levels[0][far].where("new <> 0").select("node", F.col("block").alias("sb"), "new")
                here.append(before.join(known, ["node", "sb"]).where(own("new", "sbit")).select(*keys, "node"))
            between[far] = cut(functools.reduce(DataFrame.unionByName, here).distinct())
        same = asked.where("at = to").select("src", "dst", F.lit(0).alias("length"), F.array("src").alias("path"))
        done, begun = [same], [there.select("src", "dst", "at", "tb", "tbit", F.lit(n).alias("length"), F.lit(p).alias("met")).distinct() for n, p, there in settled]
        if begun:
            away = functools.reduce(DataFrame.unionByName, [level.where("new <> 0").select(F.col("node").alias("next"), F.col("block").alias("tb"), "new", F.lit(n).alias("left")) for n, level in enumerate(levels[1])])
            walks = cut(functools.reduce(DataFrame.unionByName, begun).withColumn("path", F.array("src")))
            for n in range(1, settled[-1][0] + 1):
                on = along(walks.where(F.col("length") >= n), held[0], by_number).drop("at")
                after = on.where(F.col("met") < n).withColumn("left", F.col("length") - n).join(away, ["next", "tb", "left"]).where(own("new", "tbit")).select(on.columns)
                if n in between:
                    after = after.unionByName(on.where(F.col("met") >= n).join(between[n].select("src", "dst", F.col("node").alias("next")), ["src", "dst", "next"]).select(on.columns))
                after = after.withColumn("id", F.col("next")) if names is None else after.join(names.select(F.col("n").alias("next"), "id"), "next")
                best = after.groupBy("src", "dst", "tb", "tbit", "length", "met").agg(F.min(F.struct("id", "next")).alias("best"), F.first("path").alias("path"))
                walks = cut(best.select("src", "dst", F.col("best.next").alias("at"), "tb", "tbit", "length", "met", F.concat("path", F.array("best.id")).alias("path")))
                done.append(walks.where(F.col("length") == n).select("src", "dst", "length", "path"))
    for edges_held in held:
        edges_held.unpersist()
    found = pairs.join(functools.reduce(DataFrame.unionByName, done), ["src", "dst"], "left")
    return found.select("src", "dst", F.coalesce("length", F.lit(-1)).alias("length"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def all_paths(edges: DataFrame, pairs: DataFrame, max_edges: int = 5, names: DataFrame | None = None) -> DataFrame:
    """Every simple directed path from ``src`` to ``dst`` of 1 to ``max_edges`` edges, once for each choice among
    parallel edges: ``src``, ``dst``, ``path``. A path ends where it first meets its target. The wrappers that stop
    short of their limit pass one less. With ``names`` (``id``, ``n``) edges hold numbers, and ``pairs`` and what is told are ids.

    Paths grow from the sources and, backwards, from the targets, to half of the length each and once for all pairs of an
    end; an edge from a head to a tail joins those of a pair. Heads and tails are known by number until then, so what is
    shuffled in the middle are three numbers a row, and no row holds a path for one pair that others would hold again.
    """
    ways = steps(edges, "out").where("src <> dst")
    ways = cut(ways) if names is None else ways
    back = ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    asked = pairs.select("src", "dst").distinct().where("src <> dst")
    if names is None:
        asked = cut(asked.select("src", "dst", F.col("src").alias("start"), F.col("dst").alias("end")))
    else:
        a, b = (names.select(F.col("id").alias(x), F.col("n").alias(y)) for x, y in (("src", "start"), ("dst", "end")))
        asked = cut(asked.join(a, "src").join(b, "dst").select("src", "dst", "start", "end"))

    number = F.monotonically_increasing_id()

    def grown(over: DataFrame, first: DataFrame, times: int, ahead: bool) -> list[DataFrame]:
        """``first``, ``at``, ``path`` and a ``number`` of the simple paths of 0 to ``times`` edges from the rows of ``first``."""
        level = cut(first.select("first", F.col("first").alias("at"), F.array("id").alias("path"), number.alias("number")))
        levels = [level]
        for _ in range(times):
            on = level.join(over.withColumnsRenamed({"src": "at", "dst": "next"}), "at").drop("at")
            on = on.withColumn("id", F.col("next")) if names is None else on.join(names.select(F.col("n").alias("next"), "id"), "next")
            path = F.concat("path", F.array("id")) if ahead else F.concat(F.array("id"), "path")
            level = cut(on.where(~F.array_contains("path", F.col("id"))).select("first", F.col("next").alias("at"), path.alias("path"), number.alias("number")))
            levels.append(level)
        return levels

    behind = max_edges // 2
    heads = grown(ways, asked.select(F.col("start").alias("first"), F.col("src").alias("id")).distinct(), max(0, max_edges - behind - 1), True)
    tails = grown(back, asked.select(F.col("end").alias("first"), F.col("dst").alias("id")).distinct(), behind, False)
    short = functools.reduce(DataFrame.unionByName, heads).join(asked.select(F.col("start").alias("first"), F.col("end").alias("at"), "src", "dst"), ["first", "at"]).select("src", "dst", "path")
    if max_edges < 1:
        return short.limit(0)
    head = heads[-1].withColumnRenamed("number", "head")
    tail = functools.reduce(DataFrame.unionByName, [t.withColumn("tail", F.col("number") * len(tails) + i).drop("number") for i, t in enumerate(tails)])
    middle = head.select("head", F.col("first").alias("start"), "at").join(ways.withColumnsRenamed({"src": "at", "dst": "next"}), "at").where("next <> start").select("next", "start", "head")
    wanted = tail.select(F.col("first").alias("end"), F.col("at").alias("next"), "tail").join(asked.select("start", "end"), "end").select("next", "start", "tail")
    met_there = cut(middle.join(wanted, ["next", "start"]).select("head", "tail"))
    told = met_there.join(head.select("head", "path"), "head").drop("head").join(tail.select("tail", F.col("path").alias("rest")), "tail")
    told = told.where(~F.arrays_overlap("path", "rest"))
    return told.select(F.get("path", F.lit(0)).alias("src"), F.element_at("rest", -1).alias("dst"), F.concat("path", "rest").alias("path")).unionByName(short)
