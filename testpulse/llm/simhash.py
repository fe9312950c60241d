"""SimHash near-dedup by the generalised pigeonhole principle.

Two fingerprints of 64 bits that differ in at most ``D`` bits, cut into ``m`` parts
with thresholds ``t_1 .. t_m`` that sum to ``D - m + 1``, differ in at most ``t_i``
bits in at least one part ``i`` (a threshold of -1 leaves a part out).

1. Fingerprints are made whole text by whole text; equal ones become one node.
2. Bits that agree often go into the same part (correlations over all nodes), so
   that some parts tell a lot and others little.
3. For each part and threshold the number of candidates is estimated: pairs that
   agree in the part are counted over all nodes, and grow with the threshold as the
   bits' own probabilities say.  Dynamic programming gives each part its threshold,
   and the cheapest number of parts is taken.
4. Every node is filed under its value in each part and probes the values within the
   part's threshold.  A bucket of more than ``BLOCK`` nodes is cut into blocks, and
   each pair of blocks is a bucket of its own, so no task holds a whole hot bucket.
5. A bucket verifies its nodes by whole fingerprints, but passes on only the links of
   a spanning forest: at most one per node, never all pairs.
6. Connected components over these links.

Defined results: a null text is an empty one; texts without a word have fingerprint 0 and
are linked like any other; fewer words than a shingle make one shingle; repeated rows are
equal nodes; null ids are least only where a whole component has no other id; an empty
table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.llm.components import components
from testpulse.session import stage

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCK = 1024
#: A group below this size is compared row against row for all groups at once.
SMALL = 8
#: What verifying a pair inside a bucket costs, measured in rows that are shuffled.
PAIR_COST = 0.01
#: Numbers of parts that the dynamic program chooses from.
PART_COUNTS = (2, 3, 4, 5)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; white space and case as in ASCII."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    starts = [0, *ends]
    hashed = np.fromiter(
        (
            xxhash.xxh64_intdigest(joined[a : b - 1], SEED)
            for a, b in zip(starts, ends[shingle - 1 :], strict=False)
        ),
        dtype="<u8",
        count=len(words) - shingle + 1,
    )
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 16):  # bounded memory for very long texts
        part = hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(_id, _version: hash of the text, _fp: signed fingerprint), one row per document."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.int64())],
                ["_id", "_version", "_fp"],
            )

    named = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_version"),
        F.col(text_col).alias("_text"),
    )
    return named.mapInArrow(over, "_id long, _version long, _fp long")


# Plan: parts and thresholds


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def probes(self) -> list[int]:
        """Masks to flip: all choices of up to ``threshold`` bits of the part."""
        return [
            sum(1 << b for b in chosen)
            for r in range(self.threshold + 1)
            for chosen in itertools.combinations(self.bits, r)
        ]


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are both set, over the nodes of one task."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _bit_matrix(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total += bits.T @ bits
    rows, columns = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(columns), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"]
    )


def _grouped_bits(related: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """``parts`` groups of nearly equal size; each grows by the bit most related to it."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = max(free, key=lambda b: (related[b, list(free)].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(tuple(sorted(group)))
    return groups


def _value(mask: int) -> Column:
    return F.col("_fp").bitwiseAND(F.lit(_signed(mask)))


def _agreeing_pairs(nodes: DataFrame, masks: list[int]) -> list[float]:
    """For each mask the pairs of nodes that agree under it, counted over all nodes."""
    filed = nodes.select(
        F.posexplode(F.array(*[_value(m) for m in masks])).alias("part", "value")
    )
    pairs = (
        filed.groupBy("part", "value")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .groupBy("part")
        .agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    )
    found = {r["part"]: r["pairs"] for r in pairs.collect()}
    return [found.get(i, 0.0) for i in range(len(masks))]


def _growth(differ: np.ndarray, threshold: int) -> float:
    """P(at most ``threshold`` bits differ) / P(none differs), for independent bits."""
    chance = np.array([1.0])
    for d in differ:
        chance = np.convolve(chance, [1 - d, d])
    return float(chance[: threshold + 1].sum() / max(chance[0], 1e-300))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) that sum to ``total`` at the least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                now = (cost + more, [*chosen, t])
                if spent + t not in grown or now < grown[spent + t]:
                    grown[spent + t] = now
        best = grown
    return best[total]


def plan_parts(nodes: DataFrame, distance: int = DISTANCE) -> list[Part]:
    """The parts and thresholds with the fewest estimated probes and candidates."""
    summed = nodes.select("_fp").mapInArrow(_together, "i long, j long, n long")
    both = np.zeros((BITS, BITS))
    for r in summed.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 64 x 64 numbers
        both[r["i"], r["j"]] = r["n"]
    n_nodes = nodes.count()
    if n_nodes < 2:
        return []
    share = both.diagonal() / n_nodes
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((both / n_nodes - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    differ = 2 * share * (1 - share)
    counts = [m for m in PART_COUNTS if m <= distance + 2]
    cuts = {m: _grouped_bits(related, m) for m in counts}
    groups = [(m, bits) for m in counts for bits in cuts[m]]
    agreeing = _agreeing_pairs(nodes, [Part(bits, 0).mask for _, bits in groups])
    costs: dict[int, list[list[float]]] = {m: [] for m in counts}
    for (m, bits), pairs in zip(groups, agreeing, strict=True):
        row = [0.0]
        probes = 0
        for t in range(distance + 1):
            probes += math.comb(len(bits), t)
            estimate = max(pairs, 1.0) * _growth(differ[list(bits)], t)
            row.append(n_nodes * probes + PAIR_COST * min(estimate, n_nodes**2 / 2))
        costs[m].append(row)
    chosen = min((allocate(costs[m], distance - m + 1), m) for m in counts)
    (_, thresholds), m = chosen
    return [Part(b, t) for b, t in zip(cuts[m], thresholds, strict=True) if t >= 0]


# Candidates and verification


def _within(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    # As unsigned numbers: of signed ones the bits of the absolute value are counted.
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one group, by breadth-first search."""
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _within(left, at, distance)
            for other in left[near]:
                queue.append(other)
                yield at, other
            left = left[~near]


def _linked(distance: int):
    """Verify groups of rows (key, fp) that arrive sorted by key."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        for start, size in zip(starts[sizes >= SMALL], sizes[sizes >= SMALL], strict=True):
            for x, y in _forest(fps[start : start + size], distance):
                a.append(x)
                b.append(y)
        a, b = [np.array(a, dtype=np.int64)], [np.array(b, dtype=np.int64)]
        small = np.repeat(sizes < SMALL, sizes)
        for step in range(1, SMALL - 1):
            same = (keys[step:] == keys[:-step]) & small[step:] & (fps[step:] != fps[:-step])
            at = np.flatnonzero(same)
            at = at[_within(fps[at], fps[at + step], distance)]
            a.append(fps[at])
            b.append(fps[at + step])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"]
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.empty(0, dtype=np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
            whole = len(keys) and np.searchsorted(keys, keys[-1])  # the last group may go on
            if whole:
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)

    return over


def _keys(number: int, part: Part) -> Column:
    """The values under which a fingerprint is looked for in one part."""
    flips = F.array(*[F.lit(_signed(p)) for p in part.probes()]).cast("array<long>")
    own = _value(part.mask)
    return F.transform(flips, lambda flip: F.xxhash64(F.lit(number), own.bitwiseXOR(flip)))


def near_links(nodes: DataFrame, parts: list[Part], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly what fingerprints within ``distance`` connect."""
    if not parts:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    filed = nodes.select(
        "_fp", F.explode(F.concat(*[_keys(i, p) for i, p in enumerate(parts)])).alias("_key")
    )
    hot = (
        filed.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block)
        .select("_key", F.ceil(F.col("_n") / (block // 2)).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    own = F.pmod(F.xxhash64("_fp"), blocks).cast("int")
    dealt = (
        filed.join(hot, "_key", "left")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.when(F.col("_blocks").isNull(), F.col("_key"))
            .otherwise(F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other")))
            .alias("_bucket"),
            "_fp",
        )
    )
    return (
        dealt.repartition("_bucket")
        .sortWithinPartitions("_bucket")
        .mapInArrow(_linked(distance), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """(_id, _version, _fp, _root: a fingerprint, component_id: an id) of every document."""
    made = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(made.groupBy("_fp").agg(F.min("_id").alias("_least")), "nodes")
    roots = components(near_links(nodes, plan_parts(nodes, distance), distance))
    rooted = nodes.join(roots, nodes["_fp"] == roots["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    labels = rooted.join(named, "_root").select("_fp", "_root", "component_id")
    return made.join(labels, "_fp").select("_id", "_version", "_fp", "_root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the least id (null last), of equal ids the
    one whose text has the least hash; of rows equal in both, one."""
    found = stage(near_duplicates(docs, id_col, text_col), "components")
    rank = F.struct(F.col("_id").isNull().alias("n"), "_id", "_version")
    one = found.groupBy("_root").agg(F.min(rank).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    gone = (
        found.join(one.filter("_n > 1"), "_root")
        .filter(rank != F.col("_kept"))
        .select("_id", "_version")
        .distinct()
    )
    twice = found.groupBy("_id", "_version").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    version = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (version == gone["_version"])
    kept = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
