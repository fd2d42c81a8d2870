"""URL filters: host and path rules, and exact membership of a list by a cascade of Bloom filters.

A Bloom filter over the listed keys never misses one, but passes some others. Over a known universe of keys those false
positives can be named, and a second filter holds them; of the listed keys, it passes some wrongly, and a third holds
those; and so on until a level passes nothing wrongly. A key of the universe is listed exactly if the first level that
rejects it is an even one (counting from 1). No join with the list is needed then, and no answer is approximate.

The universe is every distinct key of the corpus, dealt into shards by hash; each shard's cascade is built by itself
from about ``shard_keys`` keys. Rows are routed to their shard's cascade, which comes first in the task that reads them,
and asked one batch after another: nothing is joined, broadcast or gathered, and it is the same at every size. A shard
whose keys have very many rows is answered in several tasks, each with a copy of the cascade.

Keys are hashes of 128 bits; of 10**10 keys, two are alike with a probability under 10**-18.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import materialize

#: False-positive rates of the first level and of all that follow.
FIRST_RATE, NEXT_RATE = 0.1, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def winning_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict), else null. ``rules`` are (verdict, host/path), a short list.

    A rule fits its host and its subdomains if the path starts with the rule's. The longest is that with most characters
    in all; of equals the one listed first.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]), reverse=True):
        h, p = split_rule(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BloomFilter:
    """Bits over keys of 128 bits (two halves ``a`` and ``b``); ``salt`` makes levels independent."""

    def __init__(self, keys: np.ndarray, rate: float, salt: int):
        self.salt = salt
        self.size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(1, len(keys)) * math.log(2)))
        bits = np.zeros(self.size, bool)
        for places in self._places(keys):
            bits[places] = True
        self.bits = np.packbits(bits)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            yield (_mixed(keys["a"] ^ _mixed(keys["b"], self.salt), 64 * self.salt + i) % np.uint64(self.size)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for places in self._places(keys):
            out &= (self.bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
        return out


class Cascade:
    """Exact membership for the keys of a universe; listed and others must not overlap."""

    def __init__(self, listed: np.ndarray, others: np.ndarray):
        self.levels: list[BloomFilter] = []
        inside, outside = listed, others
        while len(inside):
            level = BloomFilter(inside, NEXT_RATE if self.levels else FIRST_RATE, len(self.levels))
            self.levels.append(level)
            inside, outside = outside[level.holds(outside)], inside

    def holds(self, keys: np.ndarray) -> np.ndarray:
        verdict = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            passed = level.holds(keys[left])
            verdict[left[~passed]] = number % 2 == 1
            left = left[passed]
            if not len(left):
                return verdict
        verdict[left] = len(self.levels) % 2 == 1
        return verdict

    def dump(self) -> bytes:
        out = [np.array([len(self.levels)], "<i8").tobytes()]
        for f in self.levels:
            out += [np.array([f.size, f.hashes], "<i8").tobytes(), f.bits.tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, blob: bytes) -> Cascade:
        made, at = cls.__new__(cls), 8
        made.levels = []
        for number in range(int(np.frombuffer(blob, "<i8", 1)[0])):
            f = BloomFilter.__new__(BloomFilter)
            f.salt = number
            f.size, f.hashes = map(int, np.frombuffer(blob, "<i8", 2, at))
            width = (f.size + 7) // 8
            f.bits = np.frombuffer(blob, np.uint8, width, at + 16)
            at += 16 + width
            made.levels.append(f)
        return made


def key_of(*columns: Column) -> Column:
    """128 bits that stand for the columns."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second half"), *reversed(columns)).alias("b"))


def _keys(a: pa.Array, b: pa.Array) -> np.ndarray:
    out = np.empty(len(a), KEY)
    out["a"], out["b"] = a.to_numpy(False).view(np.uint64), b.to_numpy(False).view(np.uint64)
    return out


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), key), F.lit(shards))


def build_cascades(universe: DataFrame, shards: int) -> DataFrame:
    """``universe`` has distinct ``key``, ``listed`` (boolean) and ``n``, how many rows have the key. Returns ``shard``,
    ``cascade`` (binary) and ``n``."""

    def build(group: pa.Table) -> pa.Table:
        keys, listed = _keys(group.column("a").combine_chunks(), group.column("b").combine_chunks()), group.column("listed").to_numpy()
        blob = Cascade(keys[listed], keys[~listed]).dump()
        return pa.table({"shard": group.column("shard").slice(0, 1), "cascade": pa.array([blob], pa.binary()), "n": pa.array([int(group.column("n").to_numpy().sum())], pa.int64())})

    dealt = universe.select("key.a", "key.b", "listed", "n", shard_of(F.col("key"), shards).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(build, "shard bigint, cascade binary, n bigint")


def membership(rows: DataFrame, universe: DataFrame, shard_keys: int = 200_000, task_rows: int = 2_000_000) -> DataFrame:
    """``rows``, which have a ``key``, with a column ``listed`` in place of it: exact for every key of the universe (as
    :func:`build_cascades` takes it), which must hold all of theirs. A task answers about ``task_rows`` rows."""
    shards = max(1, -(-universe.count() // shard_keys))
    cascades = materialize(build_cascades(universe, shards), "cascades")
    total = cascades.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, shards // 64, -(-total // task_rows))
    names = [c for c in rows.columns if c != "key"]
    # a shard's rows are spread over as many tasks as they fill, and each of them gets the cascade
    copies = F.ceil(F.col("n") / task_rows).cast("int")
    spread = cascades.where(F.col("n") > task_rows).select("shard", copies.alias("copies"))  # at most total / task_rows shards
    spread = dict(map(tuple, spread.collect()))
    ways = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in spread.items()])), F.col("shard")) if spread else F.lit(1)
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"), "key.a", "key.b", shard_of(F.col("key"), shards).alias("shard"))
    given = given.withColumn("copy", F.pmod(F.xxhash64("given"), F.coalesce(ways, F.lit(1))).cast("bigint")).withColumn("cascade", F.lit(None).cast("binary"))
    sent = cascades.select(F.lit(None).cast(given.schema["given"].dataType).alias("given"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(copies, F.lit(1)).cast("bigint") - 1)).alias("copy"), "cascade")
    routed = given.unionByName(sent).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("cascade").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, blobs = batch.column("shard").to_numpy(), batch.column("cascade")
            sent_at = np.flatnonzero(blobs.is_valid().to_numpy(False))
            keys, out = _keys(batch.column("a"), batch.column("b")), np.zeros(len(shard), bool)
            for lo, hi in itertools.pairwise([0, *sent_at.tolist(), len(shard)]):
                if lo in sent_at:
                    now, held = shard[lo], Cascade.load(blobs[lo].as_py())
                if hi > lo:
                    assert (shard[lo:hi] == now).all()
                    out[lo:hi] = held.holds(keys[lo:hi])
            real = blobs.is_null()
            yield pa.RecordBatch.from_arrays([batch.column("given").filter(real), pa.array(out).filter(real)], ["given", "listed"])

    schema = StructType([StructField("given", given.schema["given"].dataType), StructField("listed", BooleanType())])
    return routed.mapInArrow(answer, schema).select("given.*", "listed")


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", **parameters) -> DataFrame:
    """A row a page: the id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    The longest fitting rule decides. A page without one is blocked if its (host, path) is on the list, which the cascade
    over all distinct (host, path) of the corpus tells, and else allowed. ``listed`` has ``host`` and ``path``, in any
    number; repeated rows and such as no page has change nothing.

    Null urls and such without :// have an empty host and path and fit no rule; they are listed if the list has the empty
    host and path. Repeated rows stay, null ids too; an empty table gives no rows. Only the id and the url are read,
    whatever other columns there are and however long urls are. Of rules of equal length the one given first counts.
    """
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), host_of(F.col(f"`{url_column}`")).alias("host"), path_of(F.col(f"`{url_column}`")).alias("path"))
    rows = rows.withColumn("key", key_of(F.col("host"), F.col("path"))).withColumn("won", winning_rule(F.col("host"), F.col("path"), rules))
    every = rows.select("key", F.lit(1).alias("n"), F.lit(False).alias("listed"))
    if listed is not None:
        every = every.unionByName(listed.select(key_of(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("n"), F.lit(True).alias("listed")))
    universe = materialize(every.groupBy("key").agg(F.sum("n").alias("n"), F.max("listed").alias("listed")).where("n > 0"), "url-universe")
    told = membership(rows, universe, **parameters)
    verdict = F.coalesce(F.col("won.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("won.rule").alias("rule"), verdict.alias("verdict"))
