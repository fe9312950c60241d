r"""Benchmark decontamination by suffix arrays over shards of the training words.

*Windows.*  A test item's windows are its runs of ``width`` words; an item with fewer
words is one window of its own.  A document word inside any occurrence of a window is hit.

*Shards.*  Each task cuts its documents into shards of about ``SHARD_WORDS`` words (a longer
document is one by itself; whole texts always).  Words become numbers of the test
vocabulary.  Every run of known words that is long enough to hold the shortest window gets
an end mark of its own and takes part; suffixes elsewhere cannot begin with a window.
The suffix array of these runs is sorted by prefix doubling, where each round sorts only
suffixes that are still tied.

*Search.*  All test suffixes are searched at once, a vectorised binary search over the
suffix array for each: :func:`contaminated` finds the interval of suffixes that begin with
the window at a test suffix, :func:`longest_matches` the neighbours in the full order, of
which one is a longest verbatim match, and where it lies.  A document lies whole in a
shard, so hits need no shuffle; longest matches are reduced to one row a test suffix by
an aggregation with partial maxima.

*Test items* travel in blocks: their suffixes are cut into pieces (that overlap, so that no
window is lost), dealt by hash to as many blocks as keep each at about ``BLOCK_WORDS``
words, and a block is broadcast.  More blocks than one are more passes over the
documents; what they find is joined by document.

Defined results: null and empty texts have no words and no hits; an item without words
has no window; a null item id counts as the empty string; rows of the same document id are
each a document of its own; equal item ids are one item; equal items hit alike; empty
tables give empty (or clean) results.  Columns other than id and text are not read, and
come back unchanged from :func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.bytewords import words_of
from testpulse.llm.columns import table
from testpulse.session import stage

WIDTH = 10
SHARD_WORDS = 1_000_000
#: Words of test items that are broadcast at once, and the longest piece of an item.
BLOCK_WORDS = 500_000
PIECE_WORDS = 10_000


def suffix_array(values: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` values (all, if None).

    Each value below the number of end marks occurs once; the last value is one of them.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, dtype=np.int64)  # place of the first suffix of a group of ties
    slots, keys, known = np.arange(n), values[order], 1
    while True:
        new = np.ones(len(slots), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = first
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots) or (depth is not None and known >= depth):
            return order
        tied = order[slots]  # a tied suffix has no end mark in its first ``known`` values
        keys = rank[tied] * n + rank[tied + known]
        by_key = np.argsort(keys, kind="stable")
        order[slots], keys = tied[by_key], keys[by_key]
        known *= 2


@dataclass(frozen=True)
class Tests:
    """A block of test pieces: numbers of their words, end to end, and the suffixes that are searched."""

    vocabulary: dict[bytes, int]  # from 1; 0 is any other word
    words: np.ndarray
    start: np.ndarray  # of each suffix, in words
    until: np.ndarray  # end of its piece, in words
    width: np.ndarray  # of the window at it
    item: np.ndarray  # index into names
    at: np.ndarray  # the suffix's place in its item
    names: list[str]

    @property
    def least(self) -> int:
        return int(self.width.min()) if len(self.width) else 0


def _tests(pieces: pa.Table, width: int, piece_words: int) -> Tests:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    words, start, until, widths, item, at = [], [], [], [], [], []
    for name, first, last, text in zip(*(pieces[c].to_pylist() for c in ("item", "first", "last", "text")), strict=True):
        own = text.split(b" ")
        begin = len(words)
        words.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in own)
        suffixes = max(1, len(own) - width + 1) if last else piece_words
        number = names.setdefault(name, len(names))
        for i in range(suffixes):
            start.append(begin + i)
            until.append(len(words))
            widths.append(min(width, len(own)))
            item.append(number)
            at.append(first + i)
    whole = (np.array(x, dtype=np.int64) for x in (words, start, until, widths, item, at))
    return Tests(vocabulary, *whole, list(names))


def item_blocks(
    items: DataFrame, id_col: str, text_col: str, width: int, block_words: int = BLOCK_WORDS
) -> Iterator[Tests]:
    """The blocks of test items; each is bounded, whatever the number and length of items."""
    piece_words = min(PIECE_WORDS, block_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "first", "last", "text", "n"]
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for first in range(0, max(1, len(words) - width + 1) if words else 0, piece_words):
                    part = words[first : first + piece_words + width - 1]
                    last = len(words) - first <= piece_words + width - 1
                    row = [[name or ""], [first], [last], [b" ".join(part)], [len(part)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names)

    pieces = stage(
        items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
        .mapInArrow(cut, "item string, first long, last boolean, text binary, n long")
        .distinct(),
        "test-pieces",
    )
    n_words = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    block = F.pmod(F.xxhash64("item", "first", "text"), F.lit(blocks))
    for number in range(blocks):
        yield _tests(pieces.filter(block == number).orderBy("item", "first", "text").toArrow(), width, piece_words)


class Shard:
    """Documents of one shard: the runs of known words that can hold a window, and their
    suffix array."""

    def __init__(self, docs: list[list[bytes]], tests: Tests, depth: int | None) -> None:
        get = tests.vocabulary.get
        parts = [np.array([get(w, 0) for w in words] + [0], dtype=np.int64) for words in docs]
        words = np.concatenate(parts)
        self.first = np.cumsum([0, *map(len, parts)])  # of each document
        known = words > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= max(1, tests.least)
        begin, end = begin[long], end[long]
        size = end - begin + 1  # with the end mark
        shift = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(shift[-1]) + np.repeat(begin - shift[:-1], size)
        marks = shift[1:] - 1
        self.values = words[place] + len(marks)  # numbers of words come after all end marks
        self.values[marks] = np.arange(len(marks))
        self.tests = tests.words + len(marks)
        self.place = place  # of each value among the shard's words
        order = suffix_array(self.values, depth) if len(place) else place
        self.order = order[len(marks) :]  # end marks come first

    def compared(self, test: np.ndarray, until: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sign of suffix against test, equal words) of pairs, over the words before ``until``."""
        sign, equal = np.zeros(len(test), dtype=np.int8), until - test
        left, depth = np.arange(len(test)), 0
        while (left := left[test[left] + depth < until[left]]).size:
            a, b = self.values[suffix[left] + depth], self.tests[test[left] + depth]
            apart = a != b
            sign[left[apart]] = np.sign(a[apart] - b[apart])
            equal[left[apart]] = depth
            left, depth = left[~apart], depth + 1
        return sign, equal

    def bound(self, test: np.ndarray, until: np.ndarray, above: bool) -> np.ndarray:
        """The first place in the suffix array whose suffix isn't less than (``above``: is
        greater than) the test's words before ``until``."""
        low, high = np.zeros(len(test), dtype=np.int64), np.full(len(test), len(self.order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign, _ = self.compared(test[open_], until[open_], self.order[middle])
            less = (sign < 0) | ((sign == 0) & above)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def _hits(docs: list[list[bytes]], tests: Tests) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """For each document: starts and ends of its hit runs of words, and the items found."""
    shard = Shard(docs, tests, int(tests.width.max()) if len(tests.width) else 1)
    low = shard.bound(tests.start, tests.start + tests.width, False)
    met = np.flatnonzero(low < len(shard.order))
    high = low.copy()
    high[met] = shard.bound(tests.start[met], (tests.start + tests.width)[met], True)
    found = np.flatnonzero(high > low)
    # Equal windows have one interval: its documents are looked up once, for all their items.
    intervals, of = np.unique(np.column_stack([low[found], tests.width[found], high[found]]), axis=0, return_inverse=True)
    items: list[set[int]] = [set() for _ in intervals]
    for k, item in zip(of.ravel().tolist(), tests.item[found].tolist(), strict=True):
        items[k].add(item)
    hit = np.zeros(shard.first[-1] + 1, dtype=np.int64)
    per_doc: dict[int, set[int]] = {}
    for (start, width, stop), names in zip(intervals.tolist(), items, strict=True):
        places = shard.place[shard.order[start:stop]]
        hit[places] += 1  # a place begins one window of a width only
        np.subtract.at(hit, places + width, 1)
        for doc in np.unique(shard.document(places)).tolist():
            per_doc.setdefault(doc, set()).update(names)
    covered = np.concatenate([[False], np.cumsum(hit) > 0])
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    begin, end = edge[::2], edge[1::2]
    owner = shard.document(begin)
    for doc in range(len(docs)):
        a, b = np.searchsorted(owner, [doc, doc + 1])
        first = shard.first[doc]
        found_items = sorted(tests.names[i] for i in per_doc.get(doc, ()))
        yield (begin[a:b] - first).tolist(), (end[a:b] - first).tolist(), found_items


def _sharded(
    batches: Iterator[pa.RecordBatch], key_columns: int, shard_words: int
) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Keys and words of the documents of each shard."""
    keys, docs, n_words = [], [], 0
    for batch in batches:
        own = zip(*(batch.column(i).to_pylist() for i in range(key_columns)), strict=True)
        for key, text in zip(own, batch.column(key_columns), strict=True):
            words = words_of(text.as_py())
            keys.append(key)
            docs.append(words)
            n_words += len(words)
            if n_words >= shard_words:
                yield keys, docs
                keys, docs, n_words = [], [], 0
    if docs:
        yield keys, docs


FOUND = "n_words long, n_hit long, n_items long, spans array<struct<start:long,end:long>>, items array<string>"


def _rows(keys: list, found: list, names: list[str], types: list) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*[(*k, *f) for k, f in zip(keys, found, strict=True)], strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _searched(docs: DataFrame, keys: dict[str, str], text_col: str, tests: Tests, shard_words: int) -> DataFrame:
    """The key columns and FOUND of every row, from one block of tests."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)  # a block: bounded by BLOCK_WORDS
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * len(keys) + [pa.int64()] * 3 + [span, pa.list_(pa.string())]
    names = [*keys, "n_words", "n_hit", "n_items", "spans", "items"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, words in _sharded(batches, len(keys), shard_words):
            found = [
                (len(w), sum(b) - sum(a), len(items), [{"start": x, "end": y} for x, y in zip(a, b, strict=True)], items)
                for w, (a, b, items) in zip(words, _hits(words, sent.value), strict=True)
            ]
            for i in range(0, len(own), 10_000):
                yield _rows(own[i : i + 10_000], found[i : i + 10_000], names, kinds)

    return docs.select(
        *[F.expr(source).cast("long").alias(name) for name, source in keys.items()], F.col(text_col).cast("binary")
    ).mapInArrow(search, ", ".join(f"{k} long" for k in keys) + ", " + FOUND)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Of every document: (doc_id, _version: hash of the text, n_words, n_hit, n_items,
    spans: hit runs of words, items: sorted ids)."""
    keys = {"doc_id": f"`{id_col}`", "_version": f"xxhash64(coalesce(`{text_col}`, ''))"}
    blocks = item_blocks(items, item_col, item_text_col, width, block_words)
    passes = [_searched(docs, keys, text_col, tests, shard_words) for tests in blocks]
    if len(passes) == 1:
        return passes[0]
    return _joined(stage(_every(passes), "hits"), list(keys))


def _every(passes: list[DataFrame]) -> DataFrame:
    """Rows of all passes; rows that are equal in one pass are told apart by no other, so each
    pass counts them first."""
    parts = []
    for number, found in enumerate(passes):
        counted = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("_copies"))
        parts.append(counted.withColumn("_pass", F.lit(number)))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every


def _joined(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document from what each block found: hit runs are united, items merged."""

    def unite(spans):
        """Overlapping or touching spans as one; the spans are sorted."""

        def add(done, x):
            last = F.element_at(done, -1)
            grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
            apart = (F.size(done) == 0) | (x["start"] > F.get(done, F.size(done) - 1)["end"])
            return F.when(apart, F.concat(done, F.array(x))).otherwise(
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
            )

        none = F.array().cast("array<struct<start:long,end:long>>")
        return F.aggregate(spans, none, add)

    merged = found.groupBy(*keys, "n_words").agg(  # a row a block, for equal documents
        F.first("_copies").alias("_copies"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    united = merged.withColumn("spans", unite(F.col("_spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return united.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        *keys, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "spans", "items"
    )


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(item_id, start, n_words, doc_id, at) for every test suffix that begins with a window
    found in a document: the longest verbatim match from its place ``start`` in the item (to
    the end of its piece at most), and the least document and word place where it lies."""
    parts = []
    for tests in item_blocks(items, item_col, item_text_col, width, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(tests)
        parts.append(
            docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
                _longest(sent, shard_words), "item_id string, start long, n_words long, doc_id long, at long"
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # Ids count from the least long, null first, so that "least place" is one number pair.
    best = F.max_by(
        F.struct("n_words", "doc_id", "at"),
        F.struct("n_words", (-F.coalesce("doc_id", F.lit(-(2**62)))).alias("a"), (-F.col("at")).alias("b")),
    )
    return found.groupBy("item_id", "start").agg(best.alias("_best")).select("item_id", "start", "_best.*")


def _longest(sent, shard_words: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "start", "n_words", "doc_id", "at"]
        for keys, docs in _sharded(batches, 1, shard_words):
            tests: Tests = sent.value
            shard = Shard(docs, tests, None)
            if not len(shard.order) or not len(tests.start):
                continue
            bound = shard.bound(tests.start, tests.until, False)
            best = np.zeros(len(bound), dtype=np.int64)
            where = np.zeros(len(bound), dtype=np.int64)
            for side in (np.minimum(bound, len(shard.order) - 1), np.maximum(bound - 1, 0)):
                suffix = shard.order[side]
                _, equal = shard.compared(tests.start, tests.until, suffix)
                where = np.where(equal > best, suffix, where)
                best = np.maximum(best, equal)
            # Of equally long matches the least (document, place): all of the interval.
            found = np.flatnonzero(best >= tests.width)
            ends = tests.start[found] + best[found]
            low, high = (shard.bound(tests.start[found], ends, above) for above in (False, True))
            rows = []
            for k, a, b in zip(found.tolist(), low.tolist(), high.tolist(), strict=True):
                places = shard.place[shard.order[a:b]]
                owner = shard.document(places)
                doc, at = min(
                    ((keys[d][0], p) for d, p in zip(owner.tolist(), (places - shard.first[owner]).tolist(), strict=True)),
                    key=lambda x: (x[0] is not None, x[0] or 0, x[1]),
                )
                rows.append((tests.names[tests.item[k]], int(tests.at[k]), int(best[k]), doc, at))
            if rows:
                kinds = [pa.string(), *[pa.int64()] * 4]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return search


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """``docs`` without the documents that hold a window of a test item."""
    found = contaminated(docs, items, id_col, text_col, item_col, item_text_col, width)
    affected = found.filter("n_hit > 0").select(F.col("doc_id").alias("_id"), "_version").distinct()
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(affected["_id"]) & (own == affected["_version"])
    return docs.join(affected, same, "left_anti")


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT no, width, i, array_to_string(w[i : i + width - 1], ' ') AS run
  FROM (SELECT no, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM worded, widths WHERE len(w) >= width)),
found AS (SELECT no, i, p.width, item_id FROM places p JOIN windows USING (width, run)),
hit AS (SELECT no, count(DISTINCT i + k) AS n_hit FROM (SELECT no, i, unnest(range(width)) AS k FROM found) GROUP BY no),
named AS (SELECT no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT no, item_id FROM found) GROUP BY no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (no) LEFT JOIN named USING (no)"""


def sql() -> str:
    return _SQL
