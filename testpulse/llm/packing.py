"""Best-fit packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share one sequence.  The program
asks for the least total of configurations that covers the histogram.  It is solved by
multiplicative weights: each length has a weight, a knapsack over token counts prices
the configurations (dynamic programming), the best ones are used for a small part of
all sequences, and the weights of the lengths that get ahead shrink.  The fractional
amounts are rounded down, what that leaves is solved again and at last rounded up, and the
few pieces that fit into no full configuration any more go, one by one, where they leave
the least room.

The histogram has at most ``capacity`` rows, and the plan at most ``capacity x ROUNDS``
configurations a pass (some thousands in practice), whatever the number of documents, so
the program runs on the driver and its plan is broadcast.
Everything that grows with the data is distributed: tokenizing and cutting are
map-only, pieces of one length are numbered within small buckets (see ``numbering``),
and a piece finds its sequence and offset from its length and number alone.

Defined results: a null or empty text is one piece that holds the end token only;
repeated rows are packed one by one; an empty table gives an empty result.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from testpulse.llm.columns import table
from testpulse.llm.numbering import numbered
from testpulse.session import stage

CAPACITY = 1024
END_ID = 2
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Rounds of the multiplicative weights, the rate at which a weight shrinks as its
#: length gets ahead, and the rounds that a length may be ahead.
ROUNDS = 200
RATE = 5.0
AHEAD = 2
#: Share of the pieces that rounding up leaves to best fit.
TAIL = 0.08

# Up to this length, texts of these characters are encoded by the byte-pair encoder with
# the tokenizer file's own vocabulary, which gives the same ids (tested) in a quarter of
# the time; any other text, and any that holds the string of an added token, goes to the
# tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]{0,1000000}")


def byte_names() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others
    as the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by a tokenizer file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        names = byte_names()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.plain = tiktoken.Encoding(
            "plain",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={
                bytes(names[c] for c in token): rank
                for token, rank in vocabulary.items()
                if token not in self.added
            },
            special_tokens={},
        )

    def encode(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(token in text for token in self.added):
            return self.plain.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids: array<int>."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)  # gone when the task ends: workers are used again
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*coder.encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = [doc_id.as_py(), k, start, length, zlib.crc32(part)]
                    rows.append([*row, part.astype(np.int32)] if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                kinds.append(pa.list_(pa.int32()))
                names.append("ids")
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
            )

    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(over, schema + (", ids array<int>" if with_ids else ""))


# The program


Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: for each room the index of the length
    to take first in a subset of the greatest total weight, or -1."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = usable[room]
        value = best[room - lengths[:k]] + weights[:k]
        at = int(value.argmax())
        if value[at] > best[room - 1]:
            best[room], choice[room] = value[at], at
        else:
            best[room] = best[room - 1]
    return choice


def _heaviest(room: int, lengths: np.ndarray, choice: np.ndarray) -> Counter:
    chosen: Counter = Counter()
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            length = int(lengths[choice[room]])
            chosen[length] += 1
            room -= length
    return chosen


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """Amounts of configurations that cover (nearly) all of the histogram, none of it twice.

    After round ``r`` a share ``r / rounds`` of every length should be covered.  A round
    prices all configurations once; each length that lags behind, the longest first, is
    covered by the best configuration that contains it, as far as the other lengths in
    it are not ahead by more than ``AHEAD`` rounds.  A length's weight is its size times
    exp(-RATE x how far it is ahead).
    """
    lengths = np.array(sorted(histogram))
    if not len(lengths):
        return {}
    demand = np.array([histogram[x] for x in lengths.tolist()], dtype=float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    amounts: Counter = Counter()
    for turn in range(1, rounds + 1):
        goal, most = turn / rounds, min(1.0, (turn + AHEAD) / rounds)
        live = covered < 1 - 1e-9
        if not live.any():
            break
        ahead = np.clip(covered - (turn - 1) / rounds, -0.5, 0.5)
        weights = lengths / capacity * np.exp(-RATE * ahead)
        choice = price(lengths[live], weights[live], capacity)
        for length in lengths[live][::-1].tolist():
            at = place[length]
            if covered[at] >= goal:
                continue
            config = _heaviest(capacity - length, lengths[live], choice)
            config[length] += 1
            step = (goal - covered[at]) * demand[at] / config[length]
            for other, n in config.items():
                i = place[other]
                step = min(step, (most - covered[i]) * demand[i] / n)
            if step > 0:
                amounts[tuple(sorted(config.items(), reverse=True))] += step
                for other, n in config.items():
                    covered[place[other]] += step * n / demand[place[other]]
    return dict(amounts)


def best_fit(left: Counter, capacity: int) -> Counter:
    """Configurations of best-fit decreasing, piece by piece."""
    rooms: list[int] = []  # distinct rooms, ascending
    open_at: dict[int, list[Counter]] = {}
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, used = capacity, Counter()
            else:
                room = rooms[at]
                used = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            used[length] += 1
            room -= length
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append(used)
    return Counter(
        tuple(sorted(used.items(), reverse=True)) for bins in open_at.values() for used in bins
    )


def _largest_first(left: Counter, amounts: dict[Config, float], capacity: int, keep: int) -> Counter:
    """Full configurations rounded up, those of the largest remainder first, until ``keep`` pieces
    are left; taken out of ``left``."""
    chosen: Counter = Counter()
    for config in sorted(amounts, key=lambda c: (-(amounts[c] % 1), c)):
        full = sum(length * n for length, n in config) == capacity
        if left.total() > keep and full and all(left[length] >= n for length, n in config):
            chosen[config] += 1
            _take(left, config, 1)
    return chosen


def _take(left: Counter, config: Config, often: int) -> None:
    for length, n in config:
        left[length] -= often * n
        if not left[length]:
            del left[length]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Config, int]:
    """Whole numbers of configurations that cover the histogram exactly.

    The program is solved and rounded down, and what is left is solved again, as long as that
    places a tenth of it.  The rest has some thousand pieces however many there are; its
    configurations are rounded up, all but ``TAIL`` of the pieces, which best fit adds.  Where
    best fit alone needs fewer sequences for the rest, it packs all of the rest.
    """
    chosen: Counter = Counter()
    left = Counter({length: n for length, n in histogram.items() if n})
    if left.get(capacity):
        chosen[((capacity, 1),)] = left.pop(capacity)
    n_pieces = left.total()
    while left:
        before = left.total()
        amounts = fractional(dict(left), capacity, min(ROUNDS, max(16, before // 8)))
        for config, amount in amounts.items():
            whole = min([int(amount + 1e-9), *(left[length] // n for length, n in config)])
            if whole:
                chosen[config] += whole
                _take(left, config, whole)
        if before - left.total() < before / 10:
            rest = Counter(left)
            rounded = _largest_first(rest, amounts, capacity, int(n_pieces * TAIL))
            rounded += best_fit(rest, capacity)
            fitted = best_fit(left, capacity)
            chosen += rounded if rounded.total() <= fitted.total() else fitted
            break
    return dict(chosen)


def _places(plan: dict[Config, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, per sequence, first sequence, offset) by number of the piece."""
    rows, taken, sequence = [], Counter(), 0
    for config, often in sorted(plan.items(), reverse=True):
        offset = 0
        for length, n in config:
            first = taken[length]
            taken[length] += n * often
            rows.append((length, first, taken[length] - 1, n, sequence, offset))
            offset += n * length
        sequence += often
    return rows


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (a written table with a ``length``) with sequence_id and offset."""
    counted = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in counted}  # at most ``capacity`` rows
    places = _places(solve(histogram, capacity))
    schema = "_length long, _from long, _to long, _each long, _sequence long, _offset long"
    plan = cut_pieces.sparkSession.createDataFrame(places, schema)
    n_rows = sum(histogram.values())
    ranked = numbered(cut_pieces, n_rows, "_rank", F.col("length"))
    here = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    turn = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(plan), here).select(
        *[F.col(f"`{c}`") for c in cut_pieces.columns],
        (F.col("_sequence") + F.expr("(_rank - _from) div _each")).alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return pack(stage(pieces(docs, path, id_col, text_col, capacity), "pieces"), capacity)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER_FILE))
