"""The rule cascade that turns a failing test and its history into a category."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from testpulse.functions import fixed, text


def plain_part(pattern: str) -> str:
    """The longest plain text that every match of an infra pattern contains."""
    plain = re.sub(r"\\s[+*]|\w\?", " ", pattern)
    return max(plain.split(), key=len).lower()


def infra_pattern(message: Column, stack: Column) -> Column:
    """First infra pattern found in message and stack trace, else null.

    A pattern is only tried on texts that contain its plain part; the search
    for that runs over bytes and is far cheaper than a case-blind pattern.
    """
    haystack = F.concat(
        F.coalesce(message, F.lit("")), F.lit("\n"), F.coalesce(stack, F.lit(""))
    )
    small = F.lower(haystack)
    return F.coalesce(
        *[
            F.when(
                F.contains(small, F.lit(plain_part(p))) & haystack.rlike("(?i)" + p), F.lit(p)
            )
            for p in fixed.INFRA_PATTERNS
        ]
    )


def decide(
    infra: Column,
    executions: Column,
    ratio: Column,
    failure_rate: Column,
    n_signatures: Column,
    dominant: Column,
    *,
    min_sample: int = fixed.MIN_SAMPLE,
    forced: bool = False,
) -> Column:
    """Struct (category, evidence, confidence, rule); category is null where no
    rule decides and the scorer, or else the default, has to."""

    def verdict(category, evidence, confidence, rule):
        return F.struct(
            F.lit(category).cast("string").alias("category"),
            evidence.alias("evidence"),
            F.lit(confidence).cast("double").alias("confidence"),
            F.lit(rule).alias("rule"),
        )

    undecided = verdict(None, F.lit(None).cast("string"), None, "undecided")
    if forced:
        return undecided

    known = executions.isNotNull()
    enough = known & (executions >= min_sample)
    rate_text = text.percent(failure_rate, 0)
    return (
        F.when(
            infra.isNotNull(),
            verdict("INFRA", F.concat(F.lit("Infra pattern detected: "), infra), 0.9, "infra"),
        )
        .when(
            known & (executions < min_sample),
            verdict(
                "INSUFFICIENT_DATA",
                F.concat(
                    F.lit("Only "), executions.cast("string"), F.lit(" executions (< 50 minimum)")
                ),
                1.0,
                "insufficient",
            ),
        )
        .when(
            enough & (ratio >= fixed.DOMINANT_RATIO) & (failure_rate > fixed.HALF),
            verdict(
                "REAL_BUG",
                F.concat(
                    F.lit("Dominant signature "), dominant, F.lit(" in "),
                    text.percent(ratio, 0), F.lit(" of failures, failure rate "), rate_text,
                ),
                0.85,
                "real_bug",
            ),
        )
        .when(
            enough & (n_signatures > 1) & (failure_rate < fixed.HALF),
            verdict(
                "FLAKY",
                F.concat(
                    n_signatures.cast("string"),
                    F.lit(" distinct error signatures, failure rate "), rate_text,
                ),
                0.8,
                "flaky",
            ),
        )
        .otherwise(undecided)
    )


def with_default(verdict: Column, *, forced: bool = False) -> Column:
    """Fill the conservative default where no rule decided and no scorer runs."""
    evidence = fixed.FORCED_EVIDENCE if forced else fixed.AMBIGUOUS_EVIDENCE
    default = F.struct(
        F.lit("FLAKY").alias("category"),
        F.lit(evidence).alias("evidence"),
        F.lit(0.5).alias("confidence"),
        F.lit("default").alias("rule"),
    )
    return F.when(verdict["category"].isNull(), default).otherwise(verdict)
