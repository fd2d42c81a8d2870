"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that the vocabulary can merge is filed under its merge
rank: one bucket a rank, holding list positions. A two-level bitmap over the ranks says which buckets hold anything,
so the lowest rank is found by two find-first-set steps, whatever the number of waiting pairs. Entries that a merge
has overtaken stay where they are and are skipped when they come up. A pre-token of n bytes takes O(n log n), so one
of a megabyte is no harder a megabyte than many short ones.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import dropped_when_lean

#: Letters and numbers of Unicode versions later than 16, by which the rank files' library splits text.
#: The pattern module knows them already; they count as neither here.
LATER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
LATER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"

#: Distinct pre-tokens whose ids a worker remembers at most: half of them recent, half from before.
REMEMBERED = 1_000_000
#: Pre-tokens longer than this are not remembered.
REMEMBERED_LENGTH = 64


#: Bits of a bitmap word, and each of them.
SPAN = 8
BIT = [1 << i for i in range(1 << SPAN)]


class BytePairEncoder:
    """Encodes and decodes by a rank file's merges; ids are the ranks. Special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.later = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
        self.pattern = regex.compile(pattern)
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--[{LATER_LETTERS}]][\p{{N}}--[{LATER_NUMBERS}]]]")
        exact = exact.replace(r"?\p{L}", rf"?[\p{{L}}--[{LATER_LETTERS}]]").replace(r"?\p{N}", rf"?[\p{{N}}--[{LATER_NUMBERS}]]")
        self.exact = regex.compile(exact, regex.V1)
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.pairs = [-1] * 65536  # merge ranks of two single bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.words = [0] * ((self.size >> SPAN) + 1)  # the lower bitmap level; all zero between pre-tokens

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def split(self, text: str) -> list[str]:
        """Pre-tokens, in order. Characters of later Unicode versions are rare: only texts with one take the slower pattern."""
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return self.exact.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue is laid out in here, for speed: ``buckets`` holds the positions filed under a rank (a heap), ``words``
        the lower bitmap of 256-bit words over the ranks, ``top`` the upper level, one bit a word.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # where the next token begins, and so where this one ends
        before = list(range(-1, n - 1))
        pairs, words, get = self.pairs, self.words, ranks.get
        waiting = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # the rank under which a pair is filed now
        waiting.append(-1)
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, rank in enumerate(waiting):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> SPAN] |= BIT[rank & 255]
                    top |= 1 << (rank >> SPAN)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = (word & -word).bit_length() - 1
            rank = high << SPAN | low
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word ^= BIT[low]
                words[high] = word
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue
            right = after[i]
            end = after[i] = after[right]
            waiting[right] = -1
            left = before[i]
            if end < n:
                before[end] = i
                changed = ((i, get(piece[i : after[end]], -1)), (left, get(piece[left:end], -1) if left >= 0 else -1))
            else:
                waiting[i] = -1
                changed = ((left, get(piece[left:end], -1)),) if left >= 0 else ()
            for at, new in changed:
                if at < 0 or waiting[at] == new:
                    if at != i or new < 0:
                        continue
                waiting[at] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        words[new >> SPAN] |= BIT[new & 255]
                        top |= 1 << (new >> SPAN)
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(ranks[piece[i:end]])
            i = end
        return ids

    def packed(self, piece: str) -> bytes:
        ids = self.known_before.get(piece)
        if ids is None:
            merged = self.merge(piece.encode())
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED // 2:
                self.known_before, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, packed = self.known.get, self.packed
        out = []
        for piece in self.split(text):
            ids = known(piece)
            if ids is None:
                ids = packed(piece)
                known = self.known.get
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_encoders: dict[tuple[str, str], BytePairEncoder] = {}
dropped_when_lean.append(_encoders.clear)


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder a worker process and vocabulary."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = BytePairEncoder.from_file(path, pattern)
    return _encoders[key]


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), ids: bool = True, digest: bool = False) -> DataFrame:
    """One row a document: the id, the columns ``keep``, ``n_tokens``; with ``ids`` the ids (array of int); with
    ``digest`` ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes
    that they decode to). A null text is empty and has no ids. Rows are independent: repeated rows, null ids and further
    columns change nothing, and nothing is shuffled. The vocabulary's path must exist on every worker.
    """
    carried = [id_column, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried) + ", n_tokens bigint"
    schema += ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digest
    names = [*carried, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                packed, hashes, decoded = [], [], []
                for value in batch.column(len(carried)):
                    made = coder.encode_packed(value.as_py() or "")
                    packed.append(np.frombuffer(made, "<i4") if ids else len(made) >> 2)
                    if digest:
                        hashes.append(hashlib.sha256(made).hexdigest())
                        decoded.append(hashlib.sha256(coder.decode_packed(made)).hexdigest())
                out = [batch.column(i) for i in range(len(carried))]
                out.append(pa.array([len(x) for x in packed] if ids else packed, pa.int64()))
                out += [pa.array(packed, pa.list_(pa.int32()))] if ids else []
                out += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())] if digest else []
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select(*carried, text_column).mapInArrow(run, schema)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The reverse of :func:`encode_texts`: the id and ``bytes`` (null ids: empty; ids outside the vocabulary fail)."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            out = [coder.decode(value.as_py() or []) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_column, "bytes"])

    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, bytes binary")
