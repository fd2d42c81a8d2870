"""The loops of the engine: bounded level-by-level expansion, and cutting its lineage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where that is unset, a
    temporary folder of this machine will do if executors run here too; on a cluster it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (with _ for the dots) that hold for what is written within."""
    keys = {key.replace("_", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder, and go on from there: a loop's plan stays as small as one round's.

    A checkpoint would keep what the optimiser has inferred about the columns, and in loops that grows with every round.
    What was shuffled on the way is given back at once, for nothing reads it again. The tables are removed when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuts/{uuid.uuid4().hex}"
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_cuts() -> None:
    """Remove what :func:`cut` has written."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the JVM may have ended before Python; nothing is left to do then
            return


atexit.register(forget_cuts)


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as ``src`` and ``dst``: ``out`` along them, ``in`` against them, ``both`` either way."""
    along = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    against = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return {"out": lambda: along, "in": lambda: against, "both": lambda: along.union(against)}[direction]()


#: Nodes of a group whose numbers lie together, and the bits of a number below its group's.
NEAR, WITHIN = 20_000, 33


def numbered(ids: DataFrame) -> DataFrame:
    """``id`` and ``n``, a number for each of the distinct (``id``, ``ord``), in order of ``ord``: what stands together has
    numbers of one group, which :func:`reach` keeps together. A written table, so that numbers stay."""
    rows = ids.select("id", "ord").distinct()
    groups = max(1, -(-ids.count() // NEAR))
    return cut(rows.repartitionByRange(groups, "ord", "id").sortWithinPartitions("ord", "id").withColumn("n", F.monotonically_increasing_id()))


def reach(pairs: DataFrame, starts: DataFrame, max_depth: int | None = None, names: DataFrame | None = None, by_block: bool = False) -> DataFrame:
    """``root``, ``node`` and ``depth``: what each start reaches in at most ``max_depth`` steps (None: in any number), at
    its least depth; the start itself at 0. ``pairs`` has ``src`` and ``dst``, ``starts`` has ``root``.

    Level by level for all starts at once, 64 of them a row: a row stands for a node and a block of starts, and its bits
    say which of them have met the node. So an edge is followed once for a block and not for each start, and what meets
    at a node is joined by OR, before rows are shuffled too. A node that a start has met is never expanded for it again;
    rounds end when no bit is new. Only that comes to the driver.

    Starts that follow each other make a block. With ``names`` (``id``, ``n``, see :func:`numbered`) the nodes of ``pairs``
    and ``starts`` are numbers: the edges of a group of them lie in one task, where nearly all that meets at a node meets
    before it is shuffled, and ids come in at the end, before blocks become starts. ``by_block`` adds a column ``block``, by
    which the rows already lie together: what groups by it and ``root`` shuffles none of them.
    """
    every, roots = met(pairs, starts, max_depth, names is not None)
    if names is not None:
        every = every.join(names.select(F.col("n").alias("node"), "id"), "node").select(F.col("id").alias("node"), "block", "new", "depth")
        roots = roots.join(names.select(F.col("n").alias("root"), "id"), "root").select(F.col("id").alias("root"), "block", "bit")
    every = every.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block") if by_block else every
    return every.join(roots, "block").where(F.expr("shiftright(new, bit) & 1 = 1")).select("root", "node", "depth", *["block"] * by_block)


def dealt(values: DataFrame) -> DataFrame:
    """The distinct values of the only column, 64 that follow each other a ``block``, with the ``bit`` of each in it."""
    (name,) = values.columns
    number = F.monotonically_increasing_id()  # counted through in each partition: blocks are full but for the last
    rows = cut(values.distinct().orderBy(name).withColumn("n", number))
    return rows.select(name, F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(63).cast("int").alias("bit"))


def flag() -> Column:
    """A number of which only the ``bit`` is set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))


def place(node: Column, parts: int, by_number: bool) -> Column:
    """Where the edges of a node lie."""
    return F.shiftright(node, WITHIN) if by_number else F.pmod(F.xxhash64(node), F.lit(8 * parts))


def laid(pairs: DataFrame, by_number: bool) -> DataFrame:
    """``src`` and ``dst`` with their ``place``, kept on disk by it. Who has many parallel edges makes them distinct first."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = pairs.where("src <> dst").select(place(F.col("src"), parts, by_number).alias("place"), "src", "dst")
    return held.repartition(parts, "place").sortWithinPartitions("place", "src").persist(StorageLevel.DISK_ONLY)


def along(rows: DataFrame, held: DataFrame, by_number: bool) -> DataFrame:
    """``rows`` with ``next``, each that an edge leads to from their ``at``: they go to where the edges lie, see :func:`laid`."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("place", place(F.col("at"), parts, by_number)).repartition(parts, "place")
    return rows.join(held.withColumnsRenamed({"src": "at", "dst": "next"}), ["place", "at"]).drop("place")


def stepped(front: DataFrame, held: DataFrame, by_number: bool) -> DataFrame:
    """``node``, ``block`` and ``found``, the bits ``new`` of the nodes from which an edge leads there."""
    on = along(front.select(F.col("node").alias("at"), "block", "new"), held, by_number)
    return on.groupBy(F.col("next").alias("node"), "block").agg(F.bit_or("new").alias("found"))


def met(pairs: DataFrame, starts: DataFrame, max_depth: int | None, by_number: bool) -> tuple[DataFrame, DataFrame]:
    """What :func:`reach` finds, in blocks: ``node``, ``block``, ``new`` (bits of the starts that first meet the node there)
    and ``depth``; and the starts: ``root``, ``block``, ``bit``."""
    spark = pairs.sparkSession
    held = laid(pairs if by_number else pairs.distinct(), by_number)
    roots = dealt(starts.select("root"))
    level = cut(roots.groupBy(F.col("root").alias("node"), "block").agg(F.bit_or(flag()).alias("new")).withColumn("seen", F.col("new")))
    levels = [level]
    none = F.lit(0).cast("bigint")
    with settings(spark, spark_sql_requireAllClusterKeysForCoPartition="false", spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        if max_depth is None or max_depth > 0:
            held.count()
        while max_depth is None or len(levels) <= max_depth:
            found = stepped(level.where("new <> 0"), held, by_number)
            both = found.select("node", "block", none.alias("seen"), "found").unionAll(level.select("node", "block", "seen", none))
            both = both.groupBy("node", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("found").alias("found"))
            seen, now = F.col("seen"), F.col("found")
            level = cut(both.select("node", "block", now.bitwiseAND(F.bitwise_not(seen)).alias("new"), seen.bitwiseOR(now).alias("seen")))
            if level.where("new <> 0").isEmpty():
                break
            levels.append(level)
    held.unpersist()
    told = [table.where("new <> 0").select("node", "block", "new", F.lit(depth).alias("depth")) for depth, table in enumerate(levels)]
    every = functools.reduce(DataFrame.unionByName, told)
    return every, roots


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each group that is least in ``order``: a minimum of structs, so partial minima come before a shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(order.alias("_order"), *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
