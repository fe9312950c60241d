"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the words and lines of one text, so
the whole operator is a map-only pass without user functions; nothing is
shuffled and no text meets another.

Defined results: a null text counts as an empty one; an empty text has all
measures 0 and is rejected; repeated rows are judged one by one; an empty table
gives an empty result.  Result columns replace input columns of the same name.
5-word windows are compared by their 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import SPACE, let, table, up_to, words

# Function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the and of to a in that it is was for on with as be by this are at from or an",
    "de": "der die das und ist nicht ein eine mit von zu den in sich auf für dem im des",
    "fr": "le la les de des et est un une que qui dans pour sur pas en du par avec au",
    "es": "el la los las de y que en un una se no por con para del al es lo su",
}
ALL_STOP_WORDS = sorted({w for line in STOP_WORDS.values() for w in line.split()})

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_marks", "n_stop_words", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """A text is rejected if ``100 * over / per`` (or the count ``over`` alone)
    leaves [low, high].  A ratio without a denominator (no words) never rejects."""

    name: str
    over: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def fires(self) -> Column:
        value = F.col(self.over)
        if self.per:
            value = 100 * value / F.nullif(F.col(self.per), F.lit(0))
        below = value < self.low if self.low is not None else F.lit(False)
        above = value > self.high if self.high is not None else F.lit(False)
        return F.coalesce(below | above, F.lit(False))


RULES = (
    Rule("short", "n_words", low=10),
    Rule("repeats", "n_repeat_words", "n_words", high=20),
    Rule("word_length", "word_chars", "n_words", low=250, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("shouting", "n_marks", "n_words", high=25),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=45),
)
#: The rules that the contract of ``op3_quality_rules`` calls the base.
BASE_RULES = ("short", "repeats")


def _repeat_words(w: Column) -> Column:
    """Words in 5-word windows that occur twice or more, the first included."""
    windows = F.transform(
        up_to(F.size(w) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts,
            lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), a + WINDOW) - a),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]),
        )
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.array_sort(placed), repeated)
        )

    return let(windows, count)


def measures(text: Column) -> Column:
    """Struct of counts (long) of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def kept_only(pattern: str) -> Column:
        return F.length(F.regexp_replace(whole, pattern, ""))

    def over_words(w: Column) -> Column:
        return let(
            lines,
            lambda rows: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                kept_only("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
                kept_only("[^!?]+").cast("long").alias("n_marks"),
                F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,"))).isin(ALL_STOP_WORDS)))
                .cast("long")
                .alias("n_stop_words"),
            ),
        )

    return let(words(text), over_words)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where any of the rules fires, as one expression over the measures."""
    fired = F.lit(False)
    for rule in rules:
        fired = fired | rule.fires()
    return fired


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without its text, with the measures, ``base_failed`` and ``kept``."""
    rest = [c for c in docs.columns if c != text and c not in MEASURES]
    own = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_doc")
    base = tuple(r for r in rules if r.name in BASE_RULES)
    named = docs.select(own, measures(F.col(text)).alias("_m")).select("_doc", "_m.*")
    verdict = {"base_failed": compiled(base), "kept": ~compiled(rules)}
    return named.withColumns(verdict).select("_doc.*", *MEASURES)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    lifted = docs.select(whole, measures(F.col(text)).alias("_m")).select("_doc", "_m.*")
    return lifted.filter(~compiled(rules)).select("_doc.*")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents").select("doc_id", "text"))


def _sql_rule(rule: Rule) -> str:
    value = f"100.0 * {rule.over} / nullif({rule.per}, 0)" if rule.per else rule.over
    parts = [f"{value} < {rule.low}"] if rule.low is not None else []
    parts += [f"{value} > {rule.high}"] if rule.high is not None else []
    return "coalesce(" + " OR ".join(parts) + ", false)"


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the judgement of every row of a table or subquery."""
    base = " OR ".join(_sql_rule(r) for r in RULES if r.name in BASE_RULES)
    every = " OR ".join(_sql_rule(r) for r in RULES)
    stop = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS _row, doc_id, coalesce(text, '') AS t FROM {documents}),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows
  FROM texts),
windows AS (
  SELECT _row, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT _row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM worded)),
twice AS (
  SELECT _row, i FROM windows QUALIFY count(*) OVER (PARTITION BY _row, g) > 1),
covered AS (
  SELECT _row, sum(least({WINDOW}, coalesce(nxt, i + {WINDOW}) - i)) AS n
  FROM (SELECT _row, i, lead(i) OVER (PARTITION BY _row ORDER BY i) AS nxt FROM twice)
  GROUP BY _row),
measured AS (
  SELECT _row, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(rows) - len(list_distinct(rows)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(rows)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
    len(list_filter(w, lambda x: lower(rtrim(x, '.,')) IN ({stop})))::BIGINT AS n_stop_words
  FROM worded LEFT JOIN covered USING (_row))
SELECT * EXCLUDE (_row), {base} AS base_failed, NOT ({every}) AS kept FROM measured
"""
