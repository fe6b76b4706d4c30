"""Removal of lines that repeat an earlier line, by an exact set-similarity join of their words.

Words of a line are ordered by rarity, and the first ones are its prefix. Within the threshold few
words differ, so two lines share two words that are neighbours in both prefixes (or, at thresholds
where prefixes would outgrow the lines, one word). Lines meet on these signatures; sizes and the
parities of all words rule most pairs out, the rest are compared word by word. Of each similar
pair the later line goes.

Equal word sets are one *unit* with one first place. Units first meet only the earliest unit of
each signature; what matches is decided, and only the undecided then meet all units that share a
signature in three units or more. A large cluster of variants so costs about one pair per variant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, release, staged, text_of, thinned
from tidewatch.session import cut_lineage

PERCENT = 80
#: Slots of the table of word counts.
SLOTS = 1 << 20
#: Parts in which signatures meet, if the prefixes have more than so many words.
SLICES = 3
SLICED = 1_000_000
#: Columns of a unit's parities, of 64 words' places each.
MARKS = ("mark_0", "mark_1")
#: White space besides the space that parts words within a line.
BLANKS = r"[\t\x0b\f\r]"
NEWLINE = "\n"


def word_grades(texts: DataFrame, text: str = "text") -> str:
    """The rarity table: per slot the magnitude of its number of words in all texts, 0 to 127.

    A table of SLOTS small numbers whatever the input, as text; it comes in a few hundred rows.
    """
    bodies = texts.select(F.explode(F.split(text, NEWLINE)).alias("body"))
    words = bodies.select(F.explode(F.split(_spaced(F.col("body")), " ")).alias("word")).filter("word != ''")
    uses = words.select(F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).groupBy("slot").agg(F.count("*").alias("uses"))
    every = texts.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("uses"))
    whole = uses.union(every).groupBy("slot").agg(F.sum("uses").alias("uses"))
    graded = whole.select("slot", F.least(F.floor(4 * F.log2(F.col("uses") + 1)), F.lit(127)).cast("string").alias("grade"))
    parts = graded.groupBy(F.shiftright("slot", 12).alias("part")).agg(F.array_sort(F.collect_list(F.struct("slot", "grade"))).alias("grades"))
    rows = parts.select("part", F.array_join(F.transform("grades", lambda g: g["grade"]), ",").alias("grades")).collect()
    return ",".join(r["grades"] for r in sorted(rows, key=lambda r: r["part"]))


def _coded(words: Column, grades: str) -> Column:
    """Distinct words as sorted numbers: the grade of the word's slot above 56 bits of its hash."""
    table = F.split(F.lit(grades), ",").cast("array<tinyint>")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    codes = F.transform(
        hashes,
        lambda h: F.shiftleft(F.coalesce(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0)).cast("long"), 56).bitwiseOR(
            F.shiftrightunsigned(h, 8)
        ),
    )
    return F.sort_array(F.array_distinct(codes))


def _words(line: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(_spaced(line), " "), "")


def _spaced(line: Column) -> Column:
    """The lower-cased line with plain spaces only, so that splitting it needs no pattern.

    Few lines hold other blanks; only those are rewritten.
    """
    odd = reduce(lambda x, y: x | y, [line.contains(b) for b in "\t\x0b\f\r"])
    return F.lower(F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def _lines(documents: DataFrame) -> DataFrame:
    """``(doc, twin, line, body)`` from ``(doc, text)``; ``twin`` tells texts of one key apart."""
    return documents.select("doc", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", NEWLINE)).alias("line", "body"))


def _paired(percent: int) -> bool:
    """Whether neighbours of a prefix can be the signatures of all sizes that may match another size."""
    return percent > 50 and all(_prefix_words(n, percent) <= n for n in range(1, 400) if n * (100 - percent) >= percent)


def _prefix_words(n, percent: int):
    """Words of a prefix for signatures of two neighbours.

    A word that the other set lacks parts two neighbours from each other, one that it has besides
    may part one. Within the threshold ``lost`` words, all of this set, part the most.
    """
    lost = (n * (100 - percent) - n * (100 - percent) % 100) / 100
    parted = lost * (2 * percent - 100) + n * (100 - percent)
    return (parted - parted % percent) / percent + 2


def _prefix_length(n: Column, percent: int) -> Column:
    """Words of a prefix: two sets of the wanted similarity cannot miss each other's signatures."""
    return (_prefix_words(n, percent) if _paired(percent) else n - F.floor((n * percent + 99) / 100) + 1).cast("int")


def _signatures(percent: int) -> Column:
    """Of a prefix its pairs of neighbours in the common order, or its words.

    Of two sets, take the one whose prefix ends first: what it shares of the prefix is in the
    other's prefix too, and neighbours that nothing parts are neighbours there.
    """
    if not _paired(percent):
        return F.transform("prefix", lambda w: w.cast("long"))
    heads, tails = (F.slice("prefix", i, F.size("prefix") - 1) for i in (1, 2))
    return F.zip_with(heads, tails, lambda x, y: F.call_function("shiftleft", x.cast("long"), F.lit(32)).bitwiseOR(y.cast("long")))


def _fits(percent: int) -> Column:
    """Filters of a pair by sizes and marks.

    A bit of a mark is the parity of the words that fall on it, so each bit in which two marks
    differ is a word that only one of the sets has.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS])
    sizes = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    return sizes & ((n_a + n_b - apart) * (100 + percent) >= (n_a + n_b) * 2 * percent)


def _mark(half: int) -> Column:
    """The parities of the words that fall on one of 64 bits, of all words of this half."""
    own = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - half))
    bit = lambda c: F.call_function("shiftleft", own(c).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate("codes", F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))


def repeated_lines(documents: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, twin, lines, gone)`` per distinct (key, text): its number of lines and the numbers,
    from 0, of those that repeat an earlier line.

    A line is repeated if some earlier line, by key, then place, has word sets with ``100 *
    shared >= percent * union`` (lower-cased words between white space). Whether that line itself
    goes does not matter. Lines without words never go and match nothing. NULL and empty texts
    have one line without words. NULL keys come first. Rows with equal key and text count once and share
    the result; texts of one key that differ are ordered by their lines' places, then by word set.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    docs = documents.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("doc"), text_of(f"`{text}`").alias("text"))
    grades = word_grades(docs)
    codes = _lines(docs).select("doc", "twin", "line", _coded(_words(F.col("body")), grades).alias("codes"))
    n = F.size("codes")
    length = _prefix_length(n, percent)
    prefix = F.transform(F.slice("codes", F.lit(1), length), lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    able = n * (100 - percent) >= percent
    spark = docs.sparkSession
    lines = staged(
        codes.select(
            "doc",
            "twin",
            "line",
            n.alias("n"),
            F.xxhash64("codes").alias("unit"),
            F.when(able, prefix).alias("prefix"),
            *[F.when(able, _mark(i)).alias(m) for i, m in enumerate(MARKS)],
        ),
        "lines",
    )
    release(spark)
    at = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line").cast("decimal(10,0)")
    # Units in order of their first places: of two, the one with the lesser number comes first.
    units = lines.filter("n > 0").groupBy("unit", "n", "prefix", *MARKS).agg(F.min(at.cast("decimal(38,0)")).alias("first"))
    numbered = units.orderBy("first", "unit", "n").withColumn("seq", F.monotonically_increasing_id())
    units = staged(numbered, "units")
    release(spark)
    matched = _matched(docs, units.filter("prefix IS NOT NULL"), percent)
    judged = units.select("unit", "n", "first", "seq").join(matched.withColumn("late", F.lit(True)), "seq", "left")
    # The first place of a unit stays unless the unit matches an earlier one; all others go.
    judged = judged.select("unit", "n", "first", F.coalesce("late", F.lit(False)).alias("late"))
    told = lines.select("doc", "twin", "line", "n", "unit").join(judged, ["unit", "n"], "left")
    gone = F.coalesce(F.col("late") | (at.cast("decimal(38,0)") > F.col("first")), F.lit(False))
    return told.groupBy("doc", "twin").agg(
        (F.max("line") + 1).cast("long").alias("lines"), F.array_sort(F.collect_set(F.when(gone, F.col("line")))).alias("gone")
    )


def _slices(rows: DataFrame, slices: int) -> list[DataFrame]:
    """``rows`` by their signatures in parts that are worked on one after the other."""
    return [rows.filter(F.pmod(F.hash("sig", F.lit(1)), F.lit(slices)) == i) for i in range(slices)]


def _in_turn(parts: list[DataFrame], name: str) -> DataFrame:
    """All rows of ``parts``, staged one after the other, so that one part's shuffles are on disk at a time."""
    done = []
    for part in parts:
        done.append(staged(part, name))
        release(part.sparkSession)
    return reduce(DataFrame.union, done)


def _met(postings: DataFrame) -> DataFrame:
    """``(sig, seq, head)``: per signature its units besides the first one, ``head``.

    Rows are two numbers and are sent once, since this is the largest shuffle: most signatures
    have one unit only, and nothing else is needed of a unit until another one shares its signature.
    """
    # With the join's own filters on both sides, they read one shuffle.
    spread = postings.filter("sig IS NOT NULL AND seq IS NOT NULL").repartition("sig")
    heads = spread.groupBy("sig").agg(F.min("seq").alias("head"), F.max("seq").alias("last"))
    return spread.join(heads.filter("last > head").select("sig", "head"), "sig").filter("seq > head")


def _matched(docs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """``seq`` of units that match an earlier unit."""
    spark = docs.sparkSession
    slices = SLICES if (units.agg(F.sum(F.size("prefix"))).first()[0] or 0) > SLICED else 1
    postings = units.select("seq", F.explode(_signatures(percent)).alias("sig"))
    met = _in_turn([_met(part) for part in _slices(postings, slices)], "met")
    pairs = staged(met.select(F.col("seq").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    release(spark)
    early = _later(docs, units, pairs, percent)
    release(spark)

    # What a signature's first unit left undecided meets all of its earlier units.
    told = met.select("sig", "seq").join(early.withColumn("done", F.lit(True)), "seq", "left")
    told = told.join(units.select("seq", "n", *MARKS), "seq").withColumn("done", F.coalesce("done", F.lit(False)))
    told = staged(told, "told")
    release(spark)
    more = _in_turn([_undecided(part, percent) for part in _slices(told, slices)], "more")
    more = staged(more.distinct(), "pairs")
    release(spark)
    later = _later(docs, units, more, percent)
    release(spark)
    return early.union(later).distinct()


def _side(units: DataFrame, x: str, *columns: str) -> DataFrame:
    return units.select(*columns, F.col("seq").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *MARKS)])


def _undecided(told: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: undecided units and the earlier ones that share a signature and may match."""
    pairs = _side(told.filter("NOT done"), "a", "sig").join(_side(told, "b", "sig"), "sig")
    return pairs.filter((F.col("b") < F.col("a")) & _fits(percent)).select("a", "b").distinct()


def _later(docs: DataFrame, units: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``seq`` of the later unit ``a`` of each pair ``(a, b)`` whose words are within the threshold.

    Before lines are fetched sizes and marks rule pairs out.
    """
    spark = docs.sparkSession
    placed = pairs
    for x in ("a", "b"):
        placed = placed.join(_side(units.withColumn(f"first_{x}", F.col("first")), x, f"first_{x}"), x)
    placed = staged(placed.filter(_fits(percent)).select("a", "n_a", "first_a", "n_b", "first_b"), "placed")
    release(spark)
    bodies = _unit_bodies(docs, placed.select("first_a").union(placed.select("first_b")).distinct())
    joined = placed
    for x in ("a", "b"):
        joined = joined.join(bodies.select(F.col("first").alias(f"first_{x}"), F.col("body").alias(f"body_{x}")), f"first_{x}")
    # Words are cut only here, because they are sent in far more bytes than the line; as a row of
    # their own they are cut once, not for each use in the filter.
    cut = F.struct(*[F.array_distinct(_words(F.col(f"body_{x}"))).alias(f"words_{x}") for x in ("a", "b")])
    told = joined.select("a", "n_a", "n_b", F.explode(F.array(cut)).alias("cut")).select("a", "n_a", "n_b", "cut.*")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - shared
    same_size = (F.size("words_a") == F.col("n_a")) & (F.size("words_b") == F.col("n_b"))
    near = told.filter(same_size & (shared * 100 >= union * percent))
    return cut_lineage(near.select(F.col("a").alias("seq")).distinct())


def _unit_bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(first, body)``: the line at each wanted place.

    Texts of one key that differ may give several lines for one place.
    """
    first = (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line").cast("decimal(10,0)")).cast("decimal(38,0)")
    lines = _lines(docs).select(first.alias("first"), "body")
    return thinned(lines, "first", wanted.toDF("first")).select("first", "body")


def dedup(documents: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the repeated lines taken out of the text; other columns unchanged.

    Documents whose every line with words goes are left out, because an earlier document holds
    what they say. Documents without words (NULL or empty text) stay as they are.
    """
    kept = documents.columns
    doc, twin, lines, gone = fresh(documents, "doc", "twin", "lines", "gone")
    found = repeated_lines(documents, percent, key, text).toDF(doc, twin, lines, gone).filter(F.size(gone) > 0)
    marked = documents.withColumn(doc, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63)))).withColumn(
        twin, F.xxhash64(text_of(f"`{text}`"))
    )
    joined = marked.join(found, [doc, twin], "left")
    parts = F.split(F.col(f"`{text}`"), NEWLINE)
    rest = F.filter(parts, lambda x, i: ~F.array_contains(F.col(gone), i))
    body = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(rest, NEWLINE))
    told = joined.withColumn(text, body)
    return told.filter(F.col(gone).isNull() | (F.trim(F.translate(F.col(f"`{text}`"), "\t\x0b\f\r\n", "     ")) != "")).select(*[F.col(f"`{c}`") for c in kept])
