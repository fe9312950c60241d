"""Column functions over text: clean, normalize, hash, name, format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from testpulse.functions import fixed

BLANKS = " \t\n\r\x0b\f"


def java(pattern: str) -> str:
    """A pattern in which only a line feed ends a line, for Spark's regex engine."""
    return "(?d)" + pattern


def strip(text: Column) -> Column:
    """Remove white space (not only spaces) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def strip_ansi(text: Column) -> Column:
    """Remove terminal colour codes; text without an escape is passed through."""
    return F.when(
        F.contains(text, F.lit("\x1b")), F.regexp_replace(text, fixed.ANSI, "")
    ).otherwise(text)


def strip_stamp(text: Column) -> Column:
    """Remove the CI runner's timestamp at the start of a line."""
    return F.regexp_replace(text, "^" + fixed.STAMP, "")


def normalize_error(text: Column) -> Column:
    """Replace paths, times, line numbers, addresses, pids and ports by tokens."""
    for pattern, token in fixed.ERROR_REWRITES:
        text = F.regexp_replace(text, pattern, token)
    return strip(text)


def signature(normalized: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normalized text."""
    return F.substring(F.sha2(normalized, 256), 1, 16)


def error_signature(message: Column) -> Column:
    return signature(normalize_error(F.coalesce(message, F.lit(""))))


def status_of(word: Column) -> Column:
    """Framework status word to PASSED, FAILED, ERROR or SKIPPED; else null."""
    pairs = [F.lit(part) for pair in fixed.STATUS_WORDS.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), word)


def is_failing(status: Column) -> Column:
    return status.isin(*fixed.FAILING)


def dotted_path(path: Column) -> Column:
    """File path as a test name: both slashes become dots."""
    return F.translate(path, "/\\", "..")


def repo_slug(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))


def workflow_or_url(name: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), url)


def duration_in(line: Column) -> Column:
    """Text of the first duration in a line, or null."""
    return F.when(
        F.contains(line, F.lit("in")) & line.rlike(fixed.DURATION),
        F.regexp_extract(line, fixed.DURATION, 1),
    )


def seconds(duration: Column) -> Column:
    """Duration text to seconds; absent or malformed text is 0.0."""
    plain = F.when(duration.rlike(r"^(\d+\.?\d*|\.\d+)$"), duration)
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def fixed_point(number: Column, places: int) -> Column:
    """Format with a fixed number of decimals, rounding the exact binary value
    half to even (which format_string does not: it rounds the printed digits)."""
    shape = F.lit("0" if places == 0 else "0." + "0" * places)
    return F.call_function("format_number", number, shape)


def percent(fraction: Column, places: int) -> Column:
    return F.concat(fixed_point(fraction * 100, places), F.lit("%"))


def iso_time(ts: Column) -> Column:
    """ISO-8601 text without zone, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def batch_label(offset: Column, size: Column) -> Column:
    """``batch-0000-0100``, or ``batch-0000-all`` without a size."""
    start = F.format_string("batch-%04d-", offset)
    end = F.when(size.isNull(), F.lit("all")).otherwise(F.format_string("%04d", offset + size))
    return F.concat(start, end)


def fetch_outcome(status_code: Column) -> Column:
    """HTTP status of a log download to ok, expired or error."""
    return (
        F.when(status_code.isin(200, 202), "ok")
        .when(status_code == 410, "expired")
        .otherwise("error")
    )


def cache_name(provider: Column, model: Column, test_name: Column) -> Column:
    """The flat cache file name of a verdict. Two tests can share one name, so
    tables are keyed by (provider, model, test_name) and never by this."""
    safe = test_name
    for part in ("/", "::", " "):
        safe = F.replace(safe, F.lit(part), F.lit("_"))
    return F.concat(provider, F.lit("_"), model, F.lit("_"), safe, F.lit(".json"))
