r"""Line dedup: winnowing over line hashes, matches extended both ways, repeated runs deleted.

A line ends at a line break, or at a full stop, question or exclamation mark
before a blank, as web text often holds a whole paragraph between line breaks.
A line is compared by the 64-bit hash of its words; lines without a word are
passed over.

1. *Copies*: of documents with the same lines only the first is compared with others; each later
   one is a run as a whole.
2. *Grams*: the gram at a line is the run from it on that has half of ``min_words`` words or
   four lines.  Every run of ``min_words`` words begins with one, so lines whose gram occurs once
   are left out.
3. *Units*: where every place of a gram is followed by the same next gram, and every place of that
   one is preceded by the first, the two are one unit, and so on.  A run that has one of them goes
   on to the other in both places, so runs begin and end (but for the lines behind the last
   whole gram) with units, and a passage that is always repeated whole is one unit.  Units that
   follow one another in a document are a segment.
4. *Descent*: for each unit the length of the longest run of units from it on that stands at an
   earlier place, too, is found bit by bit, the highest first.  Units that agree so far are a
   group, named by the hash of what agrees.  In a round each member of a group whose segment goes on
   for 2^k more units is keyed by its group and the hash of those; where a key has several
   members, all but the first have an earlier place that agrees so far, and move on to a group
   of their own; the first stays, and stands in that group as a source only.  One that has
   moved is replaced in its old group by that first, which agrees with it for as long as is still
   asked there, so every group has the first place of whatever is asked next.  A group has one
   such source, so a round holds at most two rows a unit, never one per pair of places.  Two more
   rounds ask in the same way for the one to three lines behind the last unit, fewer than a gram.
5. *Runs*: what begins at a unit and ends where the run from a unit before it ends is part of that
   one.  Runs of ``min_words`` words or more are the result; what several of them cover is
   deleted.  The first copy of everything stays, and nothing is chained from different places.

All such runs are found: the result is that of comparing all places (by their 64-bit hashes).

Only built-in functions are used.  The heaviest shuffle holds fixed-width rows, one per line;
text is shuffled by :func:`remove_repeats` only.  A hot key is counted before the shuffle,
and the tables that are joined are written ones, so that Spark can split its partition.

``min_words`` is 25.  A passage set into the middle of a line of other text loses its
first line to the text before it (and its last to the text behind, if it has no end
mark); what is left is found if it has ``min_words`` words.

Defined results: null and empty texts have no lines; rows that share id and text are
one document seen twice, and neither loses anything to the other; rows that share the
id alone, or have none (null comes first), are told apart by their texts; an empty table
gives an empty result.  Columns of the input other than id and text are never read by
:func:`repeated_runs` and come back unchanged from :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testpulse.llm.columns import let, table
from testpulse.session import stage, unstage

LINE_END = r"(?<=\n)|(?<=[.!?][\x20\x09])"
MIN_WORDS = 25
#: Units of a segment whose names are looked up together.
CHUNK = 128
#: Marks line ends where a text does not hold it itself.
MARK = "\x01"

DOC = ["_id", "_version"]


def _marked(text: Column) -> Column:
    """The text with ``MARK`` behind every line end that ``LINE_END`` matches.

    No two of these ends overlap, and plain texts are found faster than a pattern."""

    def behind(whole: Column, *ends: str) -> Column:
        for end in ends:
            whole = F.replace(whole, F.lit(end), F.lit(end + MARK))
        return whole

    return let(
        behind(text, "\n", ". ", "! ", "? "),
        lambda t: F.when(F.contains(t, F.lit("\t")), behind(t, ".\t", "!\t", "?\t")).otherwise(t),
    )


def pieces(text: Column) -> Column:
    """The lines of a text with their ends; joined they are the text."""
    return _cut(text, lambda t: t)


def _cut(text: Column, blanked) -> Column:
    """The lines of a text, ``blanked`` before they are cut.

    Marking is faster than cutting by the pattern; a text that holds the mark is cut by it."""

    def cut(whole: Column) -> Column:
        by_pattern = F.transform(F.split(whole, LINE_END), blanked)
        return F.when(F.contains(whole, F.lit(MARK)), by_pattern).otherwise(F.split(blanked(_marked(whole)), MARK))

    return _not_empty(let(F.coalesce(text, F.lit("")), cut))


def _not_empty(parts: Column) -> Column:
    """Without an empty piece behind the last line end."""
    return let(
        parts,
        lambda p: F.when((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == ""), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def _blanks_only(text: Column) -> Column:
    """The text with one blank for every run of white space (blanks beside a line break may stay: they are
    at the end of a line).

    The pattern is only tried on texts with other white space than line breaks and single blanks."""

    def blanked(t: Column) -> Column:
        other = F.contains(t, F.lit("  "))
        for blank in "\t\x0b\x0c\r":
            other = other | F.contains(t, F.lit(blank))
        runs = F.regexp_replace(t, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
        return F.when(other, runs).otherwise(F.replace(t, F.lit("\n"), F.lit(" ")))

    return let(text, blanked)


def _trimmed(text: Column) -> Column:
    """The words of each piece, joined by one blank; empty without any."""
    return F.transform(_cut(text, _blanks_only), lambda part: F.trim(part))


def _hash_and_words(w: Column) -> list[Column]:
    """(h, n) of the joined words of a line with a word."""
    blanks = F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit("")))
    return [F.xxhash64(w).alias("h"), (blanks + 1).alias("n")]


def worded_lines(text: Column) -> Column:
    """Struct (h: hash of the words, joined by one blank, n: words, at: index of the piece)
    of each line with a word."""

    lines = F.transform(
        _trimmed(text), lambda w, at: F.when(w != "", F.struct(*_hash_and_words(w), at.alias("at")))
    )
    return F.filter(lines, lambda x: x.isNotNull())


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _version: hash of the text, lines: array of (h, n)) of each document with a line,
    once for rows that share both."""
    return _hashed(docs, id_col, text_col).dropDuplicates(DOC)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of :func:`line_hashes`, one row a row."""
    lines = F.transform(F.array_remove(_trimmed(F.col(text_col)), ""), lambda w: F.struct(*_hash_and_words(w)))
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_version"),
        lines.alias("lines"),
    )


def _order() -> Column:
    """No id comes first."""
    return F.coalesce(F.col("_id"), F.lit(-(2**63)))


def grams(hashes: Column, counts: Column, words: int) -> Column:
    """The hash of the gram at each line, null if the lines end before it is whole."""

    def gram(n: Column, j: Column) -> Column:
        # In a lambda, Spark copies the whole array for a slice of it, but not for an element.
        h = [F.get(hashes, j + k) for k in range(4)]
        two = n + F.get(counts, j + 1)
        three = two + F.get(counts, j + 2)
        of = [F.xxhash64(*h[: k + 1]) for k in range(4)]
        return F.when(n >= words, of[0]).when(two >= words, of[1]).when(three >= words, of[2]).when(h[3].isNotNull(), of[3])

    return F.transform(counts, gram)


def _in_order(hashed: DataFrame) -> tuple[DataFrame, int]:
    """(_doc: a number that grows with id and hash of the text, DOC, lines), written; and the number of
    bits that hold the number of a line."""
    rows = 33  # bits of the row within a partition
    number = F.monotonically_increasing_id()
    made = stage(hashed.orderBy(_order(), "_version").select(number.alias("_number"), *DOC, "lines"), "documents-in-order")
    row = F.col("_number").bitwiseAND(2**rows - 1)
    most = made.agg(F.max(row), F.max(F.shiftright("_number", rows)), F.max(F.size("lines"))).first()
    row_bits, part_bits, line_bits = ((m or 0).bit_length() for m in most)
    if row_bits + part_bits + line_bits > 62:
        raise ValueError("too many lines to be numbered")
    doc = F.shiftleft(F.shiftright("_number", rows), row_bits).bitwiseOR(row)
    return made.select(doc.alias("_doc"), *DOC, "lines"), line_bits


def _bounds(found: DataFrame) -> DataFrame:
    """(_g, _opens, _closes) of each gram that is the first or last of a unit; ``found`` are the places of
    grams with several.

    If all places of a gram are followed by the same gram, and that one has no more places, then
    all its places are preceded by the first."""
    n = F.count(F.lit(1))

    def only(of: str) -> Column:
        return F.when((F.count(of) == n) & (F.min(of) == F.max(of)), F.min(of))

    classes = stage(
        found.groupBy("_g").agg(n.alias("_n"), only("_next").alias("_next"), only("_last").alias("_last")),
        "repeated-grams",
    )
    none = F.lit(0).cast("long")
    known = (
        classes.select("_g", "_n", none.alias("_before"), none.alias("_behind"))
        .union(classes.filter("_next IS NOT NULL").select("_next", none, "_n", none))
        .union(classes.filter("_last IS NOT NULL").select("_last", none, none, "_n"))
    )
    bounds = known.groupBy("_g").agg(*[F.max(c).alias(c) for c in ("_n", "_before", "_behind")]).select(
        "_g", (F.col("_before") != F.col("_n")).alias("_opens"), (F.col("_behind") != F.col("_n")).alias("_closes")
    )
    written = stage(bounds.filter("_opens OR _closes"), "bounds-of-units")
    unstage(classes)
    return written


def segments(docs: DataFrame, line_bits: int, min_words: int) -> DataFrame:
    """(_segment: the place of its first line, units: array of (place, line, last, g, two, one, third)).

    ``two`` is the hash of the two lines behind a unit, ``one`` and ``third`` are those of the first and
    third."""
    hashes, counts = F.col("lines")["h"], F.col("lines")["n"]
    split = docs.select("_doc", hashes.alias("_h"), counts.alias("_n"))

    # Each array is cut out of the lines once, not once per line.
    made = let(F.col("_h"), lambda h: let(F.col("_n"), lambda n: grams(h, n, (min_words + 1) // 2)))
    every = stage(split.select("_doc", made.alias("_grams")), "grams")
    places = every.select("_doc", "_grams", F.posexplode("_grams").alias("line", "_g")).filter("_g IS NOT NULL")
    around = [F.get("_grams", F.col("line") + 1).alias("_next"), F.get("_grams", F.col("line") - 1).alias("_last")]
    # Most grams have one place: they are counted by themselves, and nothing else of them is shuffled or written.
    several = stage(
        every.select(F.explode("_grams").alias("_g")).filter("_g IS NOT NULL").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("_g"),
        "grams-with-several-places",
    )
    found = stage(places.select("_doc", "line", "_g", *around).join(several, "_g"), "places-of-grams")
    unstage(every, several)
    bounds = _bounds(found)
    along = Window.partitionBy("_doc").orderBy("line")
    last = F.when(F.col("_closes"), F.col("line")).otherwise(F.lead("line").over(along))
    units = found.select("_doc", "line", "_g").join(bounds, "_g").withColumn("last", last).filter("_opens")
    apart = F.coalesce(F.col("line") != F.lag("last").over(along) + 1, F.lit(True))
    first = F.last(F.when(F.col("_apart"), F.col("line")), ignorenulls=True).over(along)
    placed = units.withColumn("_apart", apart).withColumn("_first", first)
    together = placed.groupBy("_doc", "_first").agg(
        F.sort_array(F.collect_list(F.struct("line", "last", F.col("_g").alias("g")))).alias("_units")
    )

    def place(line: Column) -> Column:
        return F.shiftleft("_doc", line_bits).bitwiseOR(line.cast("long"))

    def unit(u: Column) -> Column:
        behind = [F.get(F.col("_h"), u["last"] + k) for k in (1, 2, 3)]
        return F.struct(
            place(u["line"]).alias("place"), u["line"].alias("line"), u["last"].alias("last"), u["g"].alias("g"),
            F.when(behind[1].isNotNull(), F.xxhash64(*behind[:2])).alias("two"), behind[0].alias("one"),
            behind[2].alias("third"),
        )

    made = stage(
        together.join(split.select("_doc", "_h"), "_doc")
        .select(place(F.col("_first")).alias("_segment"), F.transform("_units", unit).alias("units")),
        "segments",
    )
    unstage(found, bounds)
    return made


def _first_of(places: DataFrame, key: str) -> DataFrame:
    """(key, _first: the first place) of each key with several rows, written."""
    counted = places.groupBy(key).agg(F.count(F.lit(1)).alias("_places"), F.min("_place").alias("_first"))
    return stage(counted.filter("_places > 1").drop("_places"), "first-places")


def _doubled(n: int) -> Callable[[Column], Column]:
    """Hashes of 2 n units from hashes of n units."""
    return lambda h: F.transform(h, lambda x, j: F.xxhash64(x, F.get(h, j + n)))


def _chunks(found: DataFrame, values: Column) -> DataFrame:
    """(_segment, _chunk, _values): the values of the units of each chunk."""
    whole = found.select("_segment", values.alias("_whole"))
    chunks = F.sequence(F.lit(0), F.floor((F.size("_whole") - 1) / CHUNK).cast("int"))
    return whole.select("*", F.explode(chunks).alias("_chunk")).select(
        "_segment", "_chunk", F.slice("_whole", F.col("_chunk") * CHUNK + 1, F.lit(CHUNK)).alias("_values")
    )


def _looked_up(rows: DataFrame, at: Column, found: DataFrame, values: Column) -> DataFrame:
    """``rows`` with ``_value``, the value of the unit with number ``at`` of their segment."""
    chunk = F.floor(at / CHUNK).cast("int")
    joined = rows.withColumn("_chunk", chunk).join(_chunks(found, values), ["_segment", "_chunk"])
    return joined.withColumn("_value", F.get("_values", at % CHUNK)).drop("_chunk", "_values")


def _names(found: DataFrame, bit: int) -> Column:
    """Of each unit, the hash of the 2 ** bit units from it on."""
    names = F.col("units")["g"]
    for k in range(bit):
        names = let(names, _doubled(2**k))
    return names


def _asked(keyed: DataFrame, **more: Column) -> DataFrame:
    """The rows after a round; ``_next`` names what each asks for (null: nothing), ``more`` are the columns of a row
    that finds it."""
    first = _first_of(keyed.filter("_next IS NOT NULL"), "_next")
    both = keyed.join(first, "_next", "left")
    later = F.col("_place") != F.col("_first")
    moves = {**more, "_key": F.col("_next"), "_asks": later, "_source": F.when(later, F.col("_first"))}
    stays = F.struct(*moves)
    moved = F.struct(*[value.alias(name) for name, value in moves.items()])
    after = (
        F.when(F.col("_first").isNull(), F.array(stays)).when(later, F.array(moved)).otherwise(F.array(stays, moved))
    )
    kept = [c for c in keyed.columns if c not in moves and c != "_next"]
    rows = stage(both.select(*kept, F.inline(after)), "units-so-far")
    unstage(keyed, first)
    return rows


def earlier_runs(found: DataFrame) -> DataFrame:
    """(_place, line, last, _source): of each unit that stands at an earlier place, too, the last line of the
    longest run from it on that does, and the first such place."""
    size = F.size("units")
    units = stage(
        found.select("_segment", size.alias("_size"), F.posexplode("units").alias("_at", "_unit"))
        .select("_segment", "_size", "_at", F.col("_unit.place").alias("_place"), F.col("_unit.line").alias("line"),
                F.col("_unit.g").alias("_key")),
        "units",
    )
    first = _first_of(units, "_key")
    later = F.col("_place") != F.col("_first")
    behind = F.col("_size") - F.col("_at") - 1
    columns = ["_segment", "_size", "_at", "_place", "line", "_n", "_key", "_asks", "_source"]
    begun = stage(
        units.join(first, "_key")
        .withColumns({"_n": F.lit(1), "_asks": later, "_source": F.when(later, F.col("_first")), "_behind": behind})
        .select(*columns, "_behind"),
        "repeated-units",
    )
    unstage(units, first)
    longest = begun.agg(F.max("_behind")).first()[0] or 0
    at = F.col("_at") + F.col("_n")
    rows = begun.filter("_behind = 0").select(*columns)
    waiting = None  # rows that have been asked in a round
    for bit in reversed(range(longest.bit_length())):
        goes_on = at + 2**bit <= F.col("_size")
        # Rows are not touched before the first round in which they can go on.
        asking = begun.filter(F.col("_behind").between(2**bit, 2 ** (bit + 1) - 1)).select(*columns)
        if waiting is not None:
            asking = asking.union(waiting.filter(goes_on).select(*columns))
        keyed = _looked_up(asking, at, found.filter(size > 2**bit), _names(found, bit))
        keyed = stage(keyed.select(*columns, F.xxhash64("_key", "_value").alias("_next")), "keyed-units")
        went = _asked(keyed, _n=F.col("_n") + 2**bit).select(*columns)
        before, waiting = waiting, went
        if before is not None:
            waiting = stage(went.union(before.filter(~goes_on)), "units-so-far")
            unstage(went, before)
    if waiting is not None:
        rows = rows.union(waiting)
    # Fewer lines than a gram may agree behind the last unit: two, then one.
    ends = _looked_up(rows, at - 1, found, F.transform("units", lambda u: u.dropFields("place", "line", "g")))
    ends = ends.select("_place", "line", F.col("_value.last").alias("last"), "_key", "_asks", "_source",
                       F.col("_value.one").alias("_one"), F.col("_value.third").alias("_third"),
                       F.when(F.col("_value.two").isNotNull(), F.xxhash64("_key", "_value.two")).alias("_next"))
    ends = _asked(stage(ends, "keyed-ends"), last=F.col("last") + 2, _one=F.col("_third"))
    line = F.when(F.col("_one").isNotNull(), F.xxhash64("_key", "_one")).alias("_next")
    ends = _asked(stage(ends.select("_place", "line", "last", "_key", "_asks", "_source", line), "keyed-ends"),
                  last=F.col("last") + 1)
    unstage(begun, *([waiting] if waiting is not None else []))
    return ends.filter("_asks").select("_place", "line", "last", "_source")


def alignments(hashed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _version, first_line, last_line, n_words, first_id): runs that stand at an earlier place and are
    not part of another, the first place of each; some are too short."""
    docs, line_bits = _in_order(hashed)
    found = segments(docs, line_bits, min_words)
    along = Window.partitionBy("_doc").orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1)
    runs = earlier_runs(found).select(
        F.shiftright("_place", line_bits).alias("_doc"), F.col("line").alias("first_line"),
        F.col("last").alias("last_line"), F.shiftright("_source", line_bits).alias("_first_doc"),
    )
    unstage(found)  # the runs are written
    reached = F.coalesce(F.max("last_line").over(along), F.lit(-1))
    longest = runs.withColumn("_reached", reached).filter(F.col("last_line") > F.col("_reached"))
    size = F.col("last_line") - F.col("first_line") + 1
    total = F.aggregate(
        F.slice("_n", F.col("first_line") + 1, size), F.lit(0).cast("long"), lambda sum_, n: sum_ + n
    )
    own = docs.select("_doc", *DOC, F.col("lines")["n"].alias("_n"))
    counted = longest.join(own, "_doc").select(*DOC, "first_line", "last_line", total.alias("n_words"), "_first_doc")
    sources = docs.select(F.col("_doc").alias("_first_doc"), F.col("_id").alias("first_id"))
    return counted.join(sources, "_first_doc").drop("_first_doc")


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Runs of lines that occur whole at an earlier place: one row per longest such run.

    ``_id``, ``_version`` name the document, ``first_line`` and ``last_line`` are indexes
    among its lines with words, ``n_words`` counts the run's words, and ``first_id`` is
    the id of the first place that has it.  Runs can overlap.
    """
    alike = {"_alike": F.xxhash64("lines"), "_size": F.size("lines"), "_row": F.monotonically_increasing_id()}
    # Filtered once written: a filter is pushed below the lines, which would be made twice.
    hashed = stage(_hashed(docs, id_col, text_col).withColumns(alike), "line-hashes").filter("_size > 0")
    key = ["_alike", "_size"]
    first = F.min(F.struct(_order().alias("order"), "_version", "_id", "_row"))
    copied = stage(
        hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("_places"), first.alias("_first")).filter("_places > 1")
        .drop("_places"),
        "copied-contents",
    )
    n_words = F.aggregate(F.col("lines")["n"], F.lit(0).cast("long"), lambda total, n: total + n)
    first = (F.col("_first._version") == F.col("_version")) & F.col("_first._id").eqNullSafe(F.col("_id"))
    copies = hashed.join(copied, key).filter(~first).select(
        *DOC, F.lit(0).alias("first_line"), (F.col("_size") - 1).alias("last_line"), n_words.alias("n_words"),
        F.col("_first._id").alias("first_id"),
    ).distinct()
    # One row of each content, also where rows share id and text.
    of_first = F.col("_first").isNull() | (F.col("_first._row") == F.col("_row"))
    firsts = hashed.join(copied, key, "left").filter(of_first).select(*DOC, "lines")
    counted = alignments(firsts, min_words).select(*DOC, "first_line", "last_line", "n_words", "first_id")
    return counted.union(copies).filter(F.col("n_words") >= min_words)


def _united(runs: Column) -> Column:
    """Overlapping or touching runs (sorted) as one."""

    def add(done: Column, run: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["first_line"].alias("first_line"), F.greatest(last["last_line"], run["last_line"]).alias("last_line"))
        apart = (F.size(done) == 0) | (run["first_line"] > last["last_line"] + 1)
        return F.when(apart, F.concat(done, F.array(run))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        )

    none = F.array().cast("array<struct<first_line:int,last_line:int>>")
    return F.aggregate(runs, none, add)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` without the later repeated runs, in the same columns.

    A document of which no word is left is dropped; it was a repeat as a whole.
    """
    span = F.struct(F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"))
    runs = (
        repeated_runs(docs, id_col, text_col, min_words)
        .groupBy(*DOC)
        .agg(_united(F.array_sort(F.collect_list(span))).alias("_runs"))
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_version"),
    )
    same = packed["_id"].eqNullSafe(runs["_id"]) & (packed["_version"] == runs["_version"])
    joined = packed.join(runs, same, "left").select("_doc", "_runs")
    text = F.col("_doc")[text_col]
    shortened = joined.withColumn(
        "_text", F.when(F.col("_runs").isNull(), text).otherwise(_without(text, F.col("_runs")))
    ).filter(F.col("_runs").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return shortened.select(
        *[
            F.col("_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c)
            for c in docs.columns
        ]
    )


def _without(text: Column, runs: Column) -> Column:
    """The text without the given runs of lines (sorted, apart)."""

    def gaps(parts: Column, lines: Column) -> Column:
        def gap(run: Column, k: Column) -> Column:
            start = F.coalesce(F.get(lines, F.get(runs, k - 1)["last_line"])["at"] + 1, F.lit(0))
            end = F.get(lines, run["first_line"])["at"]
            return F.array_join(F.slice(parts, start + 1, end - start), "")

        last = F.get(lines, F.get(runs, F.size(runs) - 1)["last_line"])["at"] + 1
        tail = F.array_join(F.slice(parts, last + 1, F.size(parts)), "")
        return F.concat(F.array_join(F.transform(runs, gap), ""), tail)

    return let(pieces(text), lambda parts: let(worded_lines(text), lambda lines: gaps(parts, lines)))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    runs = repeated_runs(table(spark, folder, "documents").select("doc_id", "text"))
    return runs.select(
        F.col("_id").alias("doc_id"), "first_line", "last_line", "n_words",
        F.col("first_id").alias("first_doc_id"),
    )
