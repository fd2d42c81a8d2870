"""Language-model scoring by context-tree weighting over bytes, and a unigram baseline beside it.

A byte is eight binary decisions. Each decision's context is the bits of the byte so far and the last 0 to ``DEPTH``
bytes, a path in a tree. Every node of it keeps a Krichevsky-Trofimov estimate from its counts, and weights it half and
half against what its children make of the same decisions. After training, the probability of a decision is mixed along
its path: each node's share is its posterior weight. A node that training never met hands on its parent's estimate.
Code lengths follow: the negative logarithm of a text's probability, here summed over all its bytes and an end.

All of the model follows from how often each (DEPTH + 1)-byte string occurs in the training texts. The work is laid out
so that no task and not the driver holds all of these:

1. Each scan task cuts its documents into chunks of about ``CHUNK`` bytes, and writes for each chunk the texts, packed,
   the distinct strings and words with their training counts, and how many strings its commoner contexts have.
2. Strings are dealt into parts by whole subtrees: a context of two bytes, or where it holds over an eighth of a mean part
   (as measured), of three, and so on. Contexts that were split make the top of the tree; there are at most eight a part
   for each depth, whatever the texts are like. Parts grow in number with the corpus, not in size.
3. A part sums its counts over the chunks and weights its subtrees, a bounded slice of them at a time. What the top needs
   from them is summed and goes to the driver.
4. A part, with the top of the tree from 3, computes the probability of every string that any chunk asked for, and
   answers each chunk.
5. A chunk's texts meet its answers, each chunk in a task of its own, and are scored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc_py, lean_memory, materialize

#: Bytes of context.
DEPTH = 6
#: Bytes of text in a chunk, and of those counted at once.
CHUNK = 32 << 20
PIECE = 3 << 20
#: Counts of pieces wait until they are so many, and are merged then.
WAITING = 4_000_000
#: Words whose terms a scoring task remembers; beyond, it begins again.
REMEMBERED = 150_000
#: Strings in a part, counted once for each chunk that has them; the fewest parts; the most whose shares decide what is split.
PART, LEAST_PARTS, MOST_SPLIT = 1 << 20, 64, 4096
#: Strings whose subtrees are held at once.
SLICE = 1 << 15
#: The longest context that a part is dealt by, and the least share of a chunk's strings for a context to be told.
FRONTIER, TOLD = 5, 1 << 14
#: Stands before the first byte and after the last; never in UTF-8.
EDGE = 0xFF
#: Not a word, as it is white space: the key under which ends are counted.
END = b"\n"
TEXTS, STRINGS, WORDS, CONTEXTS = 0, 1, 2, 3

_LG_HALF = np.array([math.lgamma(i + 0.5) for i in range(64)])
_LG_ONE = np.array([math.lgamma(i + 1.0) for i in range(64)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) of whole numbers n."""
    return np.where(n < 64, table[np.minimum(n, 63)], _stirling(np.maximum(n, 63) + shift))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _lgamma(zeros, _LG_HALF, 0.5) + _lgamma(ones, _LG_HALF, 0.5) - _lgamma(zeros + ones, _LG_ONE, 1.0) - math.log(math.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the posterior weight of the node's own estimate."""
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimate that the next decision is a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _runs(keys)
    return (keys[at], np.add.reduceat(counts, at)) if len(at) else (keys, counts)


class Subtrees:
    """The nodes at depths ``first`` to ``depth`` over strings (sorted, distinct; a count of 0 marks one only asked for)
    that hold all strings of their contexts of ``first`` bytes.

    Strings hold the oldest byte highest and the coded byte lowest. Node arrays, by depth and bit: ``keys`` (context
    above the prefix of the coded byte), ``zeros``, ``ones``, ``log_pw``, ``weight`` and for each string of that depth
    the place of its node.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int, first: int = 2):
        self.depth, self.first = depth, first
        self.strings = strings
        self.levels: dict[int, tuple[np.ndarray, list[dict[str, np.ndarray]]]] = {}
        self.up: dict[int, np.ndarray] = {}  # from a string of depth d + 1 to its suffix of depth d
        keys = strings
        for d in range(depth, first - 1, -1):
            nodes = []
            for j in range(8):
                prefix = keys >> np.uint64(8 - j)
                at = _runs(prefix)
                ones = np.where(keys >> np.uint64(7 - j) & np.uint64(1), counts, 0)
                begins = np.zeros(len(keys), np.int32)
                begins[at] = 1
                node = {"of": np.cumsum(begins, dtype=np.int32) - 1, "keys": prefix[at]}
                total = np.add.reduceat(counts, at) if len(at) else counts
                node["ones"] = np.add.reduceat(ones, at) if len(at) else ones
                node["zeros"] = total - node["ones"]
                own = log_kt(node["zeros"], node["ones"])
                if d == depth:
                    node["log_pw"], node["weight"] = own, np.ones(len(own))
                else:
                    below = self.levels[d + 1][1][j]
                    parent = node["of"][self.up[d][_runs(below["of"])]]
                    children = np.bincount(parent, below["log_pw"], len(own))
                    node["log_pw"], node["weight"] = weighted(own, children)
                nodes.append(node)
            self.levels[d] = (keys, nodes)
            if d > first:
                shorter = keys & np.uint64((1 << (8 * d)) - 1)
                above, inverse = np.unique(shorter, return_inverse=True)
                self.up[d - 1] = inverse
                counts = np.bincount(inverse, counts, len(above)).astype(np.int64)
                keys = above

    def _above(self, j: int) -> np.ndarray:
        """The names of the parents of the nodes at depth ``first`` for bit j."""
        keys = self.levels[self.first][1][j]["keys"]
        context = (keys >> np.uint64(j)) & np.uint64((1 << 8 * (self.first - 1)) - 1)
        return ((context << np.uint64(8)) | (keys & np.uint64((1 << j) - 1)) | np.uint64(1 << j)).astype(np.int64)

    def tops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For depth ``first`` - 1: node (context above the prefix with its leading one), zeros, ones, the children's log_pw."""
        made = []
        for j, node in enumerate(self.levels[self.first][1]):
            seen = node["zeros"] + node["ones"] > 0
            made.append((self._above(j)[seen], node["zeros"][seen], node["ones"][seen], node["log_pw"][seen]))
        return _added(*(np.concatenate(x) for x in zip(*made)))

    def log10_probabilities(self, top: Top) -> np.ndarray:
        """Of each string: that its last byte follows the others."""
        total = np.zeros(len(self.strings))
        for j in range(8):
            at = np.arange(len(self.strings))
            places = {}
            for d in range(self.depth, self.first - 1, -1):
                places[d] = self.levels[d][1][j]["of"][at]
                if d > self.first:
                    at = self.up[d - 1][at]
            alpha, beta, estimate = (x[places[self.first]] for x in top.at(self.first - 1, self._above(j)))
            # from the top: what the parent estimates, for nodes never met
            chain = []
            for d in range(self.first, self.depth + 1):
                node = self.levels[d][1][j]
                zeros, ones = node["zeros"][places[d]], node["ones"][places[d]]
                met = zeros + ones > 0
                estimate = np.where(met, kt_one(zeros, ones), estimate)
                chain.append((estimate, np.where(met, node["weight"][places[d]], 1.0)))
            mixed = chain[-1][0]
            for own, weight in reversed(chain[:-1]):
                mixed = weight * own + (1 - weight) * mixed
            one = alpha + beta * mixed
            bit = (self.strings >> np.uint64(7 - j)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total


def _added(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct nodes in order, and the sums of their values."""
    at, inverse = np.unique(node, return_inverse=True)
    return (at, *(np.bincount(inverse, x, len(at)) for x in values))


def _parents(node: np.ndarray, depth: int) -> np.ndarray:
    """The names at depth - 1 of the parents of nodes at ``depth``: their contexts without the oldest byte."""
    return node & ((1 << 8 * depth) - 1)


class Top:
    """The tree above the parts. For a node the probability of a one is alpha + beta * (what the next depth says); ``kt``
    is the estimate that it hands to a node never met below it.

    ``rows`` has for each depth what the parts summed for its nodes: node, zeros, ones, the children's log_pw. What the
    children that are in the top themselves add is added here.
    """

    def __init__(self, rows: dict[int, tuple[np.ndarray, ...]]):
        none = (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3)))
        sums, below = {}, none
        for d in range(max(rows, default=0), 0, -1):
            node, zeros, ones, children = (np.concatenate(x) for x in zip(rows.get(d, none), below))
            node, zeros, ones, children = _added(node, zeros, ones, children)
            zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
            log_pw, weight = weighted(log_kt(zeros, ones), children)
            sums[d] = node, kt_one(zeros, ones), weight
            below = _parents(node, d), zeros, ones, log_pw
        zeros, ones, children = (np.bincount(below[0], x, 256) for x in below[1:])
        zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
        _, weight = weighted(log_kt(zeros, ones), children)
        own = kt_one(zeros, ones)
        self.levels = [(np.arange(256), weight * own, 1 - weight, own)]
        for d in sorted(sums):
            node, own, weight = sums[d]
            alpha, beta, _ = self.at(d - 1, _parents(node, d))
            self.levels.append((node, alpha + beta * weight * own, beta * (1 - weight), own))

    def at(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """alpha, beta and kt of nodes at that depth, met or not."""
        if depth >= len(self.levels):  # nothing of that depth was met
            found = np.zeros(len(node), np.int64)
            hit = np.zeros(len(node), bool)
            alpha, beta, kt = np.zeros(len(node)), np.zeros(len(node)), np.zeros(len(node))
        else:
            names, alphas, betas, kts = self.levels[depth]
            found = np.minimum(np.searchsorted(names, node), max(0, len(names) - 1))
            hit = names[found] == node if len(names) else np.zeros(len(node), bool)
            alpha, beta, kt = alphas[found], betas[found], kts[found]
        if not hit.all():
            lost = ~hit
            up_alpha, up_beta, up_kt = self.at(depth - 1, _parents(node[lost], depth))
            alpha[lost], beta[lost], kt[lost] = up_alpha + up_beta * up_kt, 0.0, up_kt
        return alpha, beta, kt


def frontier(strings: np.ndarray, split: dict[int, np.ndarray]) -> np.ndarray:
    """The context that each string is dealt by, its length in the highest byte. ``split`` has by length the contexts
    (sorted) that are dealt by one byte more."""
    context = strings >> np.uint64(8)
    out = context & np.uint64(0xFFFF) | np.uint64(2 << 56)
    at = None
    for length in sorted(split):
        mine = (context if at is None else context[at]) & np.uint64((1 << 8 * length) - 1)
        heavy = _among(mine, split[length])
        at = np.flatnonzero(heavy) if at is None else at[heavy]
        if not len(at):
            break
        out[at] = context[at] & np.uint64((1 << 8 * (length + 1)) - 1) | np.uint64((length + 1) << 56)
    return out


def _among(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(keys), bool)
    return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys


def _dealt(keys: np.ndarray, parts: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A number under ``parts`` for each key."""
    mixed = keys * np.uint64(factor)
    return ((((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def slices(strings: np.ndarray, split: dict[int, np.ndarray], at_once: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The strings (as places, in order) by the length of what they are dealt by, whole contexts together, in slices of
    about ``at_once``."""
    units = frontier(strings, split)
    lengths = (units >> np.uint64(56)).astype(np.int64)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        n = -(-len(mine) // (at_once or SLICE))
        dealt = _dealt(units[mine], n, 0xD6E8FEB86659FD93)
        for number in range(n):
            if len(some := mine[dealt == number]):
                yield length, some


def common_contexts(strings: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of 2 to ``longest`` bytes (the length in the highest byte) with over 1 / TOLD of the strings, and how many."""
    keys, counts = [], []
    for length in range(2, longest + 1):
        mine = (strings >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1)
        mine = mine.astype(np.uint32) if length <= 4 else mine
        mine.sort()
        at = _runs(mine)
        n = np.diff(np.append(at, len(mine)))
        many = n * TOLD > len(strings)
        keys.append(mine[at][many].astype(np.uint64) | np.uint64(length << 56))
        counts.append(n[many])
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's (depth + 1)-byte strings, one for each of its bytes and its end, and how many each text has."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * depth + t + edge for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    rolled = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        rolled <<= np.uint64(8)
        rolled |= data[i : len(data) - depth + i]
    ends = np.cumsum(lengths + depth)
    keep = np.ones(len(rolled), bool)
    for i in range(depth):  # strings that end in the next text's edge
        over = ends[:-1] - depth + i
        keep[over] = False
    return rolled[keep], lengths


def _squeezed(values: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: what is shuffled is mostly small whole numbers and alike exponents."""
    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _spread(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_spread(blob, np.uint64), dtype=np.uint64)


class Lookup:
    """Values by 64-bit key, for very many questions in no order: levels of hash tables without chains.

    A key that another one takes the place of goes to the next, smaller level; most questions end at the first, after one
    memory access where a binary search takes twenty. Every key asked for must be there.
    """

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(6, (len(keys) - 1).bit_length())
            slot = self._slot(keys, bits)
            held, told = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, values.dtype)
            held[slot], told[slot] = keys, values
            lost = held[slot] != keys
            told[slot[~lost]] = values[~lost]
            self.levels.append((bits, held, told))
            keys, values = keys[lost], values[lost]

    def _slot(self, keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = None, None
        for bits, held, told in self.levels:
            mine = keys if left is None else keys[left]
            slot = self._slot(mine, bits)
            found = told[slot]
            missed = np.flatnonzero(held[slot] != mine)
            if left is None:
                out, left = found, missed
            else:
                out[left] = found
                left = left[missed]
            if not len(left):
                break
        return out


class _Chunk:
    """Documents of one scan task, until they are enough."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth = number, depth
        self.size = self.waiting = 0
        self.texts: list[bytes] = []
        self.ids: list = []
        self.flags: list[bool] = []
        self.rows: list[tuple] = []
        self.counted: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {STRINGS: [], WORDS: []}
        self.words: Counter[bytes] = Counter()
        self.asked: set[bytes] = set()

    def add(self, doc_id: object, text: bytes) -> None:
        text = text.lower()
        held = id_crc_py(doc_id) % 10 == 0
        self.ids.append(doc_id)
        self.texts.append(text)
        self.flags.append(held)
        (self.asked if held else self.words).update(text.split())
        if held:
            self.asked.add(END)
        else:
            self.words[END] += 1
        self.size += len(text) + 1
        self.waiting += len(text) + 1
        if self.waiting >= PIECE:
            self.count()

    def keep(self, kind: int, keys: np.ndarray, counts: np.ndarray) -> None:
        held = self.counted[kind]
        held.append((keys, counts.astype(np.uint32)))
        if len(held) > 1 and sum(len(k) for k, _ in held) >= WAITING:
            held[:] = [self.merged(kind)]

    def merged(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        held = self.counted[kind]
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        held.clear()
        return summed(keys, counts)

    def count(self) -> None:
        for held in (False, True):
            mine = [t for t, h in zip(self.texts, self.flags) if h == held]
            if mine:
                made = strings_of(mine, self.depth)[0]
                made.sort()
                at = _runs(made)
                self.keep(STRINGS, made[at], np.zeros(len(at), np.uint32) if held else np.diff(np.append(at, len(made))))
        for words in (self.words, self.asked):
            hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            counts = np.fromiter(words.values(), np.int64, len(words)) if words is self.words else np.zeros(len(words), np.int64)
            self.keep(WORDS, *summed(hashed, counts))
            words.clear()
        if self.ids:
            blob = zstandard.ZstdCompressor(3).compress(b"".join(self.texts))
            lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
            self.rows.append((TEXTS, len(self.ids), self.ids, blob, lengths.tobytes()))
        self.texts, self.ids, self.flags, self.waiting = [], [], [], 0

    def finish(self) -> list[tuple]:
        self.count()
        for kind in (STRINGS, WORDS):
            keys, counts = self.merged(kind)
            self.rows.append((kind, len(keys), None, _packed(keys), _squeezed(counts.astype(np.uint32))))
            if kind == STRINGS:
                told, n = common_contexts(keys, min(self.depth, FRONTIER) - 1)
                self.rows.append((CONTEXTS, len(told), None, _packed(told), _squeezed(n.astype(np.uint32))))
        return self.rows


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [_unpacked(b.as_py()) for b in table.column("keys")]
    counts = [_spread(b.as_py(), np.uint32) for b in table.column("counts")]
    return summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


def _whole(work: Callable[[pa.Table], pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does that takes its partition as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        if held := [b for b in batches if b.num_rows]:
            yield from work(pa.Table.from_batches(held)).to_batches(max_chunksize=1024)

    return run


def score_texts(df: DataFrame, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a document: ``doc_id``, ``held_out`` (crc32 of the id as text, mod 10, is 0; such rows teach nothing),
    ``n_tokens`` (words and an end), ``n_known``, ``train_tokens``, ``base_score`` (unigram, see the module's queries),
    ``score`` (log10 probability of the text's bytes, A-Z lower-cased, and its end) and ``bits_per_byte``.

    A null text is empty: its end alone is scored. A null id counts as the empty text, so it is held out. Repeated rows
    teach and are scored as often as they occur. An empty table gives no rows; without training rows every estimate is a
    half. Words are told apart by 64-bit hashes.
    """
    if not 2 <= depth <= 7:
        raise ValueError("contexts of 2 to 7 bytes")
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"chunk bigint, kind int, n int, ids array<{kind}>, keys binary, counts binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean_memory()
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number, depth)

        def rows(done: _Chunk) -> Iterator[pa.RecordBatch]:
            made = done.finish()
            for i in range(0, len(made), 16):
                columns = list(zip(*made[i : i + 16]))
                kinds = [pa.int32(), pa.int32(), pa.list_(id_type), pa.binary(), pa.binary()]
                arrays = [pa.array([done.number] * len(columns[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "kind", "n", "ids", "keys", "counts"])

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(doc_id, (text.as_py() or "").encode())
                if chunk.size >= CHUNK:
                    yield from rows(chunk)
                    chunk = _Chunk(chunk.number + 1, depth)
        if chunk.size:
            yield from rows(chunk)
        del chunk
        lean_memory()

    gathered = materialize(df.select(id_column, text_column).mapInArrow(gather, schema), "ctw-chunks", "none")
    sums = {r["kind"]: r["n"] for r in gathered.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    parts = max(LEAST_PARTS, -(-(sums.get(STRINGS, 0) + sums.get(WORDS, 0)) // PART))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(keys.as_py()).view(np.int64)), pa.array(_spread(counts.as_py(), np.uint32), pa.int64())], ["context", "n"])

    told = gathered.where(F.col("kind") == CONTEXTS).select("keys", "counts").mapInArrow(tell, "context bigint, n bigint").groupBy("context").agg(F.sum("n").alias("n"))
    most = sums.get(STRINGS, 0) // (8 * min(parts, MOST_SPLIT))
    heavy = np.sort(np.array([r["context"] for r in told.where(F.col("n") > most).select("context").collect()], np.uint64))
    split = {d: heavy[heavy >> np.uint64(56) == d] & np.uint64((1 << 56) - 1) for d in range(2, min(depth, FRONTIER))}
    split = df.sparkSession.sparkContext.broadcast(split)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for chunk, kind, blob, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                keys, counts = _unpacked(blob.as_py()), _spread(more.as_py(), np.uint32)
                part = np.empty(len(keys), np.uint16 if parts <= 1 << 16 else np.int32)
                for i in range(0, len(keys), 1 << 18):
                    some = keys[i : i + (1 << 18)]
                    part[i : i + (1 << 18)] = _dealt(frontier(some, split.value) if kind == STRINGS else some, parts)
                order = np.argsort(part, kind="stable")
                keys, counts, part = keys[order], counts[order], part[order]
                del order
                at = _runs(part)
                edges = list(zip(at.tolist(), [*at[1:].tolist(), len(part)]))
                for i in range(0, len(edges), 256):
                    some = edges[i : i + 256]
                    where = part[[lo for lo, _ in some]].astype(np.int32) + (0 if kind == STRINGS else parts)
                    columns = [pa.array([x] * len(some), t) for x, t in ((chunk, pa.int64()), (kind, pa.int32()))]
                    blobs = [pa.array([f(x[lo:hi]) for lo, hi in some], pa.binary()) for f, x in ((_packed, keys), (_squeezed, counts))]
                    yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(where.astype(np.int32)), *blobs], ["chunk", "kind", "part", "keys", "counts"])

    asked = gathered.where(F.col("kind").isin(STRINGS, WORDS)).select("chunk", "kind", "keys", "counts")
    asked = asked.mapInArrow(deal, "chunk bigint, kind int, part int, keys binary, counts binary").repartitionById(2 * parts, "part")

    def summarise(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        made = []
        if table.column("kind")[0].as_py() == WORDS:
            made.append((np.array([-1]), np.array([-1]), counts.sum(keepdims=True), np.array([(counts > 0).sum()]), np.zeros(1)))
        else:
            keys, counts = keys[counts > 0], counts[counts > 0]
            for first, at in slices(keys, split.value):
                node, *values = Subtrees(keys[at], counts[at], depth, first).tops()
                made.append((np.full(len(node), first - 1), node, *values))
        columns = [np.concatenate([m[i] for m in made]) if made else np.zeros(0) for i in range(5)]
        kinds = {"depth": np.int32, "node": np.int64, "zeros": float, "ones": float, "children": float}
        return pa.table({name: c.astype(t) for (name, t), c in zip(kinds.items(), columns)})

    tops = asked.mapInArrow(_whole(summarise), "depth int, node bigint, zeros double, ones double, children double")
    tops = tops.groupBy("depth", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).toPandas().sort_values(["depth", "node"])
    words = tops[tops["depth"] < 0]
    n_tokens, n_distinct = int(words["zeros"].sum()), int(words["ones"].sum())
    top = Top({d: tuple(rows[c].to_numpy() for c in ("node", "zeros", "ones", "children")) for d, rows in tops[tops["depth"] > 0].groupby("depth")})
    held = df.sparkSession.sparkContext.broadcast(top)

    def answer(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        if table.column("kind")[0].as_py() == STRINGS:
            values = np.zeros(len(keys), np.float32)
            for first, at in slices(keys, split.value):
                values[at] = Subtrees(keys[at], counts[at], depth, first).log10_probabilities(held.value)
        else:
            values = counts
        replies = [_squeezed(values[np.searchsorted(keys, _unpacked(b.as_py()))]) for b in table.column("keys")]
        return table.select(["chunk", "kind", "keys"]).append_column("counts", pa.array(replies, pa.binary()))

    answers = asked.mapInArrow(_whole(answer), "chunk bigint, kind int, keys binary, counts binary")
    texts = gathered.where(F.col("kind") == TEXTS).select("chunk", "kind", "ids", "keys", "counts")
    together = texts.unionByName(answers.withColumn("ids", F.lit(None).cast(f"array<{kind}>")).select("chunk", "kind", "ids", "keys", "counts"))
    # chunks counted through: a row a scan task says where its own begin
    task, number = F.shiftright("chunk", 32), F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF))
    tasks = sorted(tuple(r) for r in texts.groupBy(task.alias("task")).agg((F.max(number) + 1).alias("n")).collect())
    begins = [(t, sum_before) for (t, _), sum_before in zip(tasks, itertools.accumulate((n for _, n in tasks), initial=0))]
    chunks = max(1, sum(n for _, n in tasks))
    begins = df.sparkSession.createDataFrame(begins, "task bigint, begin bigint")
    together = together.withColumn("task", task).join(F.broadcast(begins), "task").withColumn("place", (F.col("begin") + number).cast("int"))
    together = together.repartitionById(chunks, "place").select("kind", "ids", "keys", "counts")

    def finish(table: pa.Table) -> pa.Table:
        by = {k: [i for i, x in enumerate(table.column("kind").to_pylist()) if x == k] for k in (TEXTS, STRINGS, WORDS)}
        keys_column, counts_column = table.column("keys"), table.column("counts")

        def lookup(k: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate([_spread(counts_column[i].as_py(), dtype) for i in by[k]])
            keys, at = np.empty(len(values), np.uint64), 0
            for i in by[k]:
                part = _unpacked(keys_column[i].as_py())
                keys[at : at + len(part)] = part
                at += len(part)
            return keys, values

        log10_p = Lookup(*lookup(STRINGS, np.float32))
        count_of = Lookup(*lookup(WORDS, np.int64))
        term = lambda c: math.log10((c + 0.1) / (n_tokens + 0.1 * (n_distinct + 1)))
        known: dict[bytes, float] = {}
        unknown: set[bytes] = set()

        def learn(new: list[bytes]) -> None:
            hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
            for word, count in zip(new, count_of(hashed).tolist()):
                known[word] = term(count)
                if not count:
                    unknown.add(word)

        learn([END])
        end_term, end_known = known[END], END not in unknown
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for i in by[TEXTS]:
            blob = zstandard.ZstdDecompressor().decompress(keys_column[i].as_py())
            lengths = np.frombuffer(counts_column[i].as_py(), np.int64)
            ends = np.cumsum(lengths).tolist()
            texts = [blob[e - n : e] for e, n in zip(ends, lengths.tolist())]
            ids = table.column("ids")[i].as_py()
            made, sizes = strings_of(texts, depth)
            found = np.empty(len(made))
            for lo in range(0, len(made), 1 << 18):
                found[lo : lo + (1 << 18)] = log10_p(made[lo : lo + (1 << 18)])
            scores = np.add.reduceat(found, np.cumsum(sizes) - sizes)
            for doc_id, text, score in zip(ids, texts, scores.tolist()):
                tokens = text.split()
                if len(known) > REMEMBERED:
                    known.clear()
                    unknown.clear()
                if new := [w for w in set(tokens) if w not in known]:
                    learn(new)
                missed = sum(w in unknown for w in tokens) if unknown else 0
                out["doc_id"].append(doc_id)
                out["held_out"].append(id_crc_py(doc_id) % 10 == 0)
                out["n_tokens"].append(len(tokens) + 1)
                out["n_known"].append(len(tokens) - missed + end_known)
                out["base_score"].append(sum(map(known.__getitem__, tokens)) + end_term)
                out["score"].append(score)
                out["n_bytes"].append(len(text) + 1)
        out["train_tokens"] = [n_tokens] * len(out["doc_id"])
        out["bits_per_byte"] = (-np.array(out["score"]) / math.log10(2) / np.array(out["n_bytes"])).tolist()
        id_type = table.column("ids").type.value_type
        kinds = {"doc_id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "bits_per_byte": pa.float64()}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return together.mapInArrow(_whole(finish), result)
