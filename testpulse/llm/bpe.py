"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is encoded on its own.  A segment tree over its
byte positions holds, at each position where a live token starts, the rank of the
pair of that token and the next; its root is the leftmost pair of least rank.  A
merge changes three positions (the merged token, its live neighbour to the left,
the one that vanished), each a logarithmic update, so a match of n bytes takes
O(n log n) however long it is.

Matches repeat a lot, so each task keeps the ids of those it has seen, and what these
decode to, in a dictionary of bounded size; that changes nothing in the result.  Documents are
encoded where they lie: nothing is shuffled.

Defined results: a null text is an empty one; an empty text has no ids; an empty
table gives an empty result; repeated rows give equal rows.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import table

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Matches that a task remembers, and the longest (in bytes) that it does.
MEMORY = 500_000
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the leftmost pair of least rank is merged until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    size = 1 << max(1, (n - 1).bit_length())
    shift = size.bit_length()
    none = 1 << 62
    get = ranks.get
    end = list(range(1, n + 2))  # where the token that starts here ends
    start = list(range(-1, n))  # where the token before the one that starts here starts
    # A leaf is rank and place in one number: the least is the leftmost of least rank.
    tree = [none] * (2 * size)
    for at in range(n - 1):
        rank = get(word[at : at + 2])
        if rank is not None:
            tree[size + at] = rank << shift | at
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while tree[1] < none:
        at = tree[1] & (size - 1)
        gone = end[at]
        stop = end[at] = end[gone]
        changed = [(gone, none)]
        rank = None
        if stop < n:
            start[stop] = at
            rank = get(word[at : end[stop]])
        changed.append((at, none if rank is None else rank << shift | at))
        before = start[at]
        if before >= 0:
            rank = get(word[before:stop])
            changed.append((before, none if rank is None else rank << shift | before))
        for place, value in changed:
            node = place + size
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.seen: dict[str, tuple[list[int], str, bytes, int]] = {}

    def _match(self, match: str) -> tuple[list[int], str, bytes, int]:
        known = self.seen.get(match)
        if known is None:
            word = match.encode()
            ids = merge(word, self.ranks)
            known = ids, " ".join(map(str, ids)), self.decode(ids), len(ids)
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[match] = known
        return known

    def parts(self, text: str) -> list[tuple[list[int], str, bytes, int]]:
        """(ids, ids as text, bytes that the ids decode to, number of ids) of each match in turn."""
        seen, slow = self.seen.get, self._match
        return [seen(m) or slow(m) for m in self.split.findall(text)]

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable([p[0] for p in self.parts(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(id, ids: array<int>) of every document."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"]
            )

    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(over, "_id long, ids array<int>")


def decode(
    encoded: DataFrame, path: str, id_col: str = "_id", ids_col: str = "ids",
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(id, bytes: binary) of every row of ids; null ids are none."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            raw = [coder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["_id", "bytes"])

    named = encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids"))
    return named.mapInArrow(over, "_id long, bytes binary")


def digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """Count and digest of the ids, and digest of what they decode to, by document.

    Both directions run in one pass, so ids and bytes never leave the task.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            counts, ids_digests, byte_digests = [], [], []
            for text in batch.column(1).to_pylist():
                parts = coder.parts(text) if text else []
                counts.append(sum([p[3] for p in parts]))
                ids_digests.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                 pa.array(byte_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(
        over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), public_tokenizers.path(RANKS_FILE))
