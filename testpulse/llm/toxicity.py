"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Two models, one of toxic and one of ordinary labelled texts, give each character of a
word a probability from the characters before it (up to ``ORDER - 1``, the start of the
word included).  An n-gram that its class has seen often is discounted and counted;
for a rare one both models back off to the same shorter context, whose probabilities
come from continuation counts over *all* documents (in how many ways an n-gram is
extended to the left).  So words that neither class knows well say nothing, and
variants of a word share its stem.

A word's evidence is the difference of its two log-likelihoods.  A document has two
length-normalised figures: the mean evidence a word, and that of its strongest word (the
same at the length of one), as few words make a long text toxic.  A logistic
function of both, fitted on labelled rows that the models have not seen, is the score.

Spark's own functions do the counting: words of all documents, then n-grams of the
distinct words, continuation counts and probabilities order by order as joins.  Scoring is
map-only.  The tasks get the evidence of every n-gram that the labelled sample holds; no
other has any of its own.

Bounds, as parameters: at most ``SAMPLE`` labelled rows a class and fold are learned from
(those of the least hash), and of them as many as have ``SAMPLE_CHARS`` characters together
(in that order; the first always).  So what is sent to the tasks depends on the
sample, not on the corpus.  Everything counted over the corpus covers all of it.

Defined results: a null text is an empty one; a text without words has evidence 0; rows
without an id, or with an id that has no label, are scored like any other; of several
labels for an id the greatest counts; without rows of both classes to learn from every
score is 0; an empty table gives an empty result.  Columns other than id and text are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.session import stage

ORDER = 5
DISCOUNT = 0.75
SAMPLE = 20_000
SAMPLE_CHARS = 50_000_000
THRESHOLD = 0.3
HELD_OUT = 2
#: Remainders of crc32(id) mod 4 that the language models and the logistic function learn from.
MODEL_FOLDS = (0, 1)
FIT_FOLD = 3
#: Kinds of learnable texts: ordinary and toxic ones of the model folds, and of the fit fold.
KINDS = ("n0", "n1", "m0", "m1")
#: Words whose evidence a task remembers, if they are not longer than that.
REMEMBERED = 200_000
#: Characters of a word whose n-grams are listed at once.
PIECE = 256
LONGEST_REMEMBERED = 64

#: Letters, numbers and underscores, as Python's and as Java's patterns write them.
_WORD = re.compile(r"\w+")
_JAVA_WORD = r"[\p{L}\p{N}_]+"


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def learnable(
    named: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(_id, _toxic, _fold): a bounded sample of the labelled rows not held out."""
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .withColumn("_fold", fold(F.col("_id")).cast("int"))
    )
    parts = [
        known.filter((F.col("_toxic") == toxic) & F.col("_fold").isin(*folds))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
        .withColumn("_part", F.lit(2 * toxic + len(folds)))
        for toxic in (0, 1)
        for folds in (MODEL_FOLDS, (FIT_FOLD,))
    ]
    drawn = stage(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), "drawn-labels")  # 4 x sample rows
    sizes = (
        named.join(F.broadcast(drawn.select("_id", "_part")), "_id")
        .groupBy("_id", "_part")
        .agg(F.sum(F.coalesce(F.length("_text"), F.lit(0))).alias("_chars"))
    )
    before = Window.partitionBy("_part").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = sizes.withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    fits = (F.col("_before") == 0) | (F.col("_before") + F.col("_chars") <= chars)
    return drawn.drop("_part").join(sized.filter(fits).select("_id"), "_id", "left_semi")


def count_words(classed: DataFrame) -> DataFrame:
    """(word, n0, n1, m0, m1): occurrences of every word of (_text, _kind) in texts of each
    kind; 0 for words that occur in texts without a kind only."""
    found = classed.select("_kind", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(_JAVA_WORD), F.lit(0))).alias("word"))
    # Words of the many unlabelled texts are only told apart, not counted.
    return found.groupBy("word").agg(
        *[F.count_if(F.col("_kind") == i).alias(k) for i, k in enumerate(KINDS)]
    )


def count_grams(words: DataFrame) -> DataFrame:
    """(gram, n0, n1, m0, m1): all n-grams of words, with class counts for those of full context.

    A word is cut into pieces of ``PIECE`` characters, with the context of the first before them,
    so that a very long one is never a list of all its n-grams."""
    marked = F.concat(F.lit("^"), "word", F.lit("$"))

    def piece(start: Column) -> Column:
        context = F.least(start, F.lit(ORDER - 1))
        text = F.substring(F.col("_marked"), start - context + 1, context + PIECE)
        return F.struct(text.alias("_piece"), F.greatest(context + 1, F.lit(2)).alias("_from"))

    starts = F.sequence(F.lit(0), F.length("_marked") - 1, F.lit(PIECE))
    cut = words.withColumn("_marked", marked).select(*KINDS, F.inline(F.transform(starts, piece)))
    ends = cut.select(*KINDS, "_piece", F.explode(F.sequence(F.col("_from"), F.length("_piece"))).alias("_end"))
    end = F.col("_end")

    def gram(n: int) -> Column:
        text = F.substring(F.col("_piece"), end - (n - 1), F.lit(n))
        return F.when(end >= n, F.struct(text.alias("gram"), (F.least(end, F.lit(ORDER)) == n).alias("full")))

    # Not a function over arrays: Spark compiles this.
    each = ends.select(*KINDS, F.explode(F.array(*[gram(n) for n in range(1, ORDER + 1)])).alias("_g"))
    return (
        each.filter(F.col("_g").isNotNull())
        .groupBy(F.col("_g.gram").alias("gram"))
        .agg(*[F.sum(F.when(F.col("_g.full"), F.col(k)).otherwise(0)).alias(k) for k in KINDS])
    )


def _shared(grams: DataFrame) -> DataFrame:
    """(rest, p): probability of the last character after the others, from
    continuation counts of all documents, for every n-gram below the highest order."""
    counts = stage(
        grams.filter(F.length("gram") > 1)
        .groupBy(F.expr("substring(gram, 2)").alias("rest"))
        .agg(F.count(F.lit(1)).alias("n")),
        "continuations",
    )
    context = F.expr("left(rest, length(rest) - 1)").alias("context")
    totals = counts.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    rated = stage(
        counts.withColumn("context", context)
        .join(totals, "context")
        .select(
            "rest",
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("own"),
            (DISCOUNT * F.col("types") / F.col("total")).alias("off"),
            "types",
        ),
        "rated",
    )
    level = rated.filter(F.length("rest") == 1).select(
        "rest", (F.col("own") + F.col("off") / (F.col("types") + 1)).alias("p")
    )
    every = level
    for order in range(2, ORDER):
        shorter = level.select(F.col("rest").alias("_shorter"), F.col("p").alias("_p"))
        level = (
            rated.filter(F.length("rest") == order)
            .withColumn("_shorter", F.expr("substring(rest, 2)"))
            .join(shorter, "_shorter")
            .select("rest", (F.col("own") + F.col("off") * F.col("_p")).alias("p"))
        )
        every = every.union(level)
    return every


def evidence(grams: DataFrame, shared: DataFrame) -> dict[str, float]:
    """Log-likelihood differences of n-grams (key: the n-gram) and of characters that
    are new to a context (key: a blank and the context), from the counts n0 and n1.

    A row for each n-gram and context of the labelled sample: its size is the sample's."""
    seen = grams.filter("n0 + n1 > 0")
    context = F.expr("left(gram, length(gram) - 1)").alias("context")
    totals = seen.groupBy(context).agg(
        *[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)],
        *[F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"k{c}") for c in (0, 1)],
    )

    def off(c: int) -> Column:
        rate = DISCOUNT * F.col(f"k{c}") / F.nullif(F.col(f"t{c}"), F.lit(0))
        return F.coalesce(rate, F.lit(1.0))

    def likely(c: int) -> Column:
        own = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.nullif(F.col(f"t{c}"), F.lit(0))
        return F.coalesce(own, F.lit(0.0)) + off(c) * F.col("p")

    shared = shared.withColumnRenamed("rest", "_rest")
    known = (
        seen.withColumn("context", context)
        .withColumn("_rest", F.expr("substring(gram, 2)"))
        .join(shared, "_rest")
        .join(totals, "context")
        .select(F.col("gram").alias("key"), F.log(likely(1) / likely(0)).alias("value"))
    )
    new = totals.select(
        F.concat(F.lit(" "), "context").alias("key"), F.log(off(1) / off(0)).alias("value")
    )
    rows = known.union(new).toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


class Scorer:
    """Evidence of words by the collected log-likelihood differences."""

    def __init__(self, values: dict[str, float]) -> None:
        self.values = values
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        known = self.words.get(word)
        if known is None:
            marked, known, values = f"^{word}$", 0.0, self.values
            for end in range(2, len(marked) + 1):
                gram = marked[max(0, end - ORDER) : end]
                value = values.get(gram)
                known += values.get(" " + gram[:-1], 0.0) if value is None else value
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = known
        return known

    def figures(self, text: str | None) -> tuple[float, float]:
        """(mean evidence a word, evidence of the strongest word)."""
        words = _WORD.findall((text or "").lower())
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if e is None else e for w, e in zip(words, found, strict=True)]
        return (math.fsum(found) / len(found), max(found)) if found else (0.0, 0.0)


def fit(figures: np.ndarray, toxic: np.ndarray, steps: int = 50, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method; weights of (mean, strongest, 1)."""
    x = np.column_stack([figures, np.ones(len(figures))])
    scale = np.array([*np.maximum(figures.std(axis=0), 1e-9), 1.0])
    x = x / scale
    weights = np.zeros(3)
    keep = ridge * np.array([1.0, 1.0, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (toxic - p) - keep * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        weights = weights + np.linalg.solve(bend, slope)
    return weights / scale


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """(values, weights) from all documents and a bounded sample of the labels.

    The weights are fitted with models that have not seen the fit fold; the values
    returned are of models that have learned from it, too.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sample = stage(learnable(named, labels), "learnable")  # at most 4 x SAMPLE narrow rows
    kind = (F.col("_toxic") + 2 * (F.col("_fold") == FIT_FOLD).cast("int")).alias("_kind")
    classed = named.join(F.broadcast(sample.select("_id", kind)), "_id", "left")
    words = stage(count_words(classed), "words")
    grams = stage(count_grams(words), "grams")
    shared = stage(_shared(grams), "shared")
    unseen = named.join(
        F.broadcast(sample.filter(F.col("_fold") == FIT_FOLD).select("_id", "_toxic")), "_id"
    )
    scorer = spark.sparkContext.broadcast(evidence(grams, shared))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(scorer.value)
        for batch in batches:
            both = [judge.figures(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64()),
                 batch.column(1)],
                ["mean", "most", "toxic"],
            )

    judged = (
        unseen.select("_text", "_toxic")
        .mapInArrow(figures, "mean double, most double, toxic int")
        .toPandas()
    )
    scorer.destroy()  # its tasks have ended
    toxic = judged["toxic"].to_numpy(dtype=float)
    whole = grams.select("gram", (F.col("n0") + F.col("m0")).alias("n0"), (F.col("n1") + F.col("m1")).alias("n1"))
    values = spark.sparkContext.broadcast(evidence(whole, shared))
    if not 0 < toxic.sum() < len(toxic):
        return values, None
    order = np.lexsort((toxic, judged["most"], judged["mean"]))  # the same sums on every run
    return values, fit(judged[["mean", "most"]].to_numpy()[order], toxic[order])


def keep_ordinary(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    values, weights = learn(docs, labels, id_col, text_col)

    @F.pandas_udf("double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Scorer(values.value)  # once a task
        for texts in batches:
            yield pd.Series(_rated(texts, judge, weights), dtype="float64")

    return docs.filter(rated(F.col(text_col)) < THRESHOLD)


def _rated(texts, judge: Scorer, weights: np.ndarray | None) -> np.ndarray:
    figures = np.array([[*judge.figures(t), 1.0] for t in texts]).reshape(-1, 3)
    if weights is None:
        return np.zeros(len(figures))
    return 1 / (1 + np.exp(-np.clip(figures @ weights, -700, 700)))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_id, _version: hash of the text, held_out, score, predicted) of every document."""
    values, weights = learn(docs, labels, id_col, text_col)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(values.value)
        for batch in batches:
            made = _rated(batch.column(2).to_pylist(), judge, weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made)], ["_id", "_version", "score"]
            )

    named = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_version"),
        F.col(text_col).alias("_text"),
    )
    return named.mapInArrow(over, "_id long, _version long, score double").select(
        "_id",
        "_version",
        (fold(F.col("_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(F.col("_id").alias("doc_id"), "held_out", "score", "predicted")
