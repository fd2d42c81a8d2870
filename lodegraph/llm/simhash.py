"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 4 bits share a variant: a value that differs from either in at most 2.
So every fingerprint emits its variants, and fingerprints that meet at one are linked: the two halves of the way add up
to at most 4 bits, so a meeting is a proof and needs no pairs compared.

A ball of radius 2 over 64 bits has 2,081 values, 33 KB a fingerprint, far beyond what can be shuffled. Here only
fingerprints are shuffled: the 64 bits are cut into ``blocks`` parts, and since at most 4 of them hold differing bits,
some blocks - 4 of them agree. For each choice of those parts a fingerprint goes to the bucket of their value, and there
emits its variants in the other bits, in memory. With 5 parts that is 5 rows of 8 bytes and 1,327 to 1,379 variants each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, join_counted, lean_memory, materialize, utf8_texts
from .components import components, smallest_reachable

BITS = 64
#: Fingerprints whose variants are held at once: about 70 MB of values.
AT_ONCE = 3000
#: Buckets in a task, and the tasks beyond which it gets more.
BUCKETS, MOST_TASKS = 6, 50_000
#: Documents' shingle hashes that are counted bit by bit at once.
HASHES_AT_ONCE = 65_536


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole sequence if there are fewer words."""
    tokens = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not tokens:
        return []
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(b" ".join(tokens), seed)]
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops)]


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is in over half the hashes; 0 without words."""
    hashes = np.array(shingle_hashes(text, words, seed), ">u8")
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[i : i + HASHES_AT_ONCE].view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long), a row a document; a null text is empty."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            made = np.fromiter((fingerprint(t, words, seed) for t in utf8_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return df.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, fp bigint")


def parts(blocks: int) -> list[int]:
    """Masks of the blocks, which cover the 64 bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(cuts)]


def routes(blocks: int, distance: int) -> list[int]:
    """Masks of the bits that agree, one of which holds for any two fingerprints within the distance."""
    return [sum(chosen) for chosen in itertools.combinations(parts(blocks), blocks - distance)]


def ball(free: int, radius: int) -> np.ndarray:
    """What to flip: every set of at most ``radius`` of the free bits."""
    bits = [1 << b for b in range(BITS) if free >> b & 1]
    return np.array([sum(c) for r in range(radius + 1) for c in itertools.combinations(bits, r)], np.uint64)


def meetings(values: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places in ``values``) between fingerprints that share a variant: each with the first that has it.

    Variants are dealt into slices by a hash, so that however many fingerprints a bucket has, only a slice's variants
    are held at once. Sorting shows which values occur twice; a bit table then leaves few of which to find the owners.
    """
    slices = -(-len(values) // AT_ONCE)
    step = max(1, AT_ONCE * len(flips) // max(1, len(values)))  # flips applied at once
    found_a, found_b = [], []
    for number in range(slices):
        held, owner = [], []
        for i in range(0, len(flips), step):
            made = values[:, None] ^ flips[None, i : i + step]
            if slices > 1:
                mine = (made * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                rows, cols = np.nonzero(mine % np.uint64(slices) == number)
                held.append(made[rows, cols])
                owner.append(rows.astype(np.int32))
            else:
                held.append(made.ravel())
                owner.append(np.repeat(np.arange(len(values), dtype=np.int32), made.shape[1]))
        variants, owners = np.concatenate(held), np.concatenate(owner)
        ordered = np.sort(variants)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice):
            continue
        place = lambda v: ((v * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)
        table = np.zeros(1 << 22, bool)
        table[place(twice)] = True
        near = np.flatnonzero(table[place(variants)])
        at = np.minimum(np.searchsorted(twice, variants[near]), len(twice) - 1)
        hit = twice[at] == variants[near]
        at, who = at[hit], owners[near[hit]].astype(np.int64)
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first = np.repeat(who[starts], np.diff(np.append(starts, len(at))))
        pairs = np.unique(first[first != who] * len(values) + who[first != who])
        found_a.append(pairs // len(values))
        found_b.append(pairs % len(values))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def links(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (``a``, ``b``) that connect the fingerprints of ``distinct`` (column ``fp``) within the distance: not all
    pairs, but a path for each of them. ``blocks`` by default grows with their number so that a bucket's mean stays
    under AT_ONCE: 5 to 30 million, 6 to 6 thousand million, and so on.
    """
    count = distinct.count()
    if blocks is None:
        blocks = distance + 1
        while count > AT_ONCE << min(bin(m).count("1") for m in routes(blocks, distance)):
            blocks += 1
    masks = routes(blocks, distance)
    flips = [ball(~m & (2**BITS - 1), distance // 2) for m in masks]
    groups = max(1, -(-count // AT_ONCE))
    signed = [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]
    routed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])).alias("r"))
    routed = routed.select("fp", "r.route", F.pmod(F.xxhash64("r.route", "r.key"), F.lit(groups)).alias("part"))
    # few bytes and much work: the number of tasks goes by buckets
    buckets = groups * len(masks)
    routed = routed.repartition(max(1, -(-buckets // max(BUCKETS, buckets // MOST_TASKS))), "route", "part")

    def run(table: pa.Table) -> pa.Table:
        lean_memory()
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = meetings(values, flips[table.column("route")[0].as_py()])
        root = smallest_reachable(len(values), a, b)
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[root[linked]].view(np.int64), "b": values[linked].view(np.int64)})

    return routed.groupBy("route", "part").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, distance: int = 4, words: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", blocks: int | None = None) -> DataFrame:
    """A row a document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest doc_id reachable over
    links of at most ``distance`` bits, its own included) and ``n_alike`` (documents of the component).

    Documents with the same fingerprint are linked by having it, so only distinct fingerprints are routed and contracted,
    however many copies there are. Null and empty texts have the fingerprint zero and are linked to each other and to
    whatever is near zero. Null ids take part but name no component: one of null ids alone has a null id. Repeated rows
    stay. An empty table gives no rows.
    """
    if distance % 2:
        raise ValueError("the distance must be even: both sides emit variants within half of it")
    made = materialize(fingerprints(df, words, seed, id_column, text_column), "simhash")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct, "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance, blocks), "simhash-links")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_alike"))
    named = rooted.select("fp", "root", "n").join(named, "root").select("fp", "component_id", "n_alike", "n")
    out = join_counted(made, named, "fp", "n", counts=distinct)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_alike")


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", group: Callable[..., DataFrame] = near_duplicates, **parameters) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays (a null id is the
    smallest; of rows with the same id the one with the smaller hash), once however often it is repeated. ``group``
    names each row's component. Texts are shuffled to meet the verdicts."""
    given = df.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in given])
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"), row.alias("row"))
    known = keyed.select(F.struct(F.col(f"given.`{id_column}`").alias("id"), "row").alias("id"), F.col(f"given.`{text_column}`").alias("text"))
    groups = group(known, id_column="id", text_column="text", **parameters)
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id.row").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    first = hold(first)
    first.count()  # so that its size is known
    once = keyed.join(first.where("n = 1").select("row"), "row", "left_semi")
    again = keyed.join(first.where("n > 1").select("row"), "row", "left_semi").dropDuplicates(["row"])
    return once.select("given.*").unionByName(again.select("given.*"))
