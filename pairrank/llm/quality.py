"""Quality rules for documents; DataFrame functions only.

Fixed rules count words, characters, symbols, repeated lines and repeated three-word
windows. The learned rule compares two histograms of a document with references: the
classes of its characters, and its common words. References are sums over all documents
of a language; a document is judged by its Jensen-Shannon distance to the nearest one,
and only where it is long enough for its histogram to mean something.

All counting happens inside a row with array functions, so nothing but the references is
shuffled, and those are a few rows of each language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.llm.common import BLANKS, WORD

#: Least words; share of repeated words (percent) that fails; symbols that are counted.
MIN_WORDS, MAX_REPEATED, SYMBOLS = 50, 50, "#*$%&|<>"
#: A histogram of fewer characters or words is not judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 50
#: Greatest Jensen-Shannon distances (base 2, 0 to 1) to the nearest reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.5
#: Common words of a language, languages with a reference, and the words a language needs for one.
COMMON_WORDS, MAX_LANGUAGES, MIN_REFERENCE_WORDS = 40, 64, 2_000
#: Character classes, in the order in which they are taken off the text; the rest is symbols.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\p{L}\p{M}]+", r"\p{N}+", r"""[.,;:!?'"()\-]+""")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; they end at blanks, tabs and line ends only."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def repeated_words(w: Column, h: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``h`` has the words' hashes."""

    def fold(a: Column, b: Column) -> Column:
        return F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b)

    # zip_with fills the shorter list with nulls, so the last two keys are null and cut off.
    pairs = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), fold)
    keys = F.slice(F.zip_with(pairs, F.slice(h, F.lit(3), F.size(h)), fold), F.lit(1), F.size(h) - 2)

    def same(x: Column, y: Column) -> Column:
        equal = x.k == y.k
        for step in range(3):
            equal = equal & (F.get(w, x.i + step) == F.get(w, y.i + step))
        return F.coalesce(equal, F.lit(False))

    def spread(s: Column) -> Column:
        again = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    def covered(k: Column) -> Column:
        placed = F.sort_array(F.transform(k, lambda key, i: F.struct(key.alias("k"), i.alias("i"))))
        # Sorting is for texts that repeat anything at all.
        return F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(_let(placed, spread))

    return F.when(F.size(h) < 3, 0).otherwise(_let(keys, covered))


def counts_of(h: Column, wanted: list[int]) -> Column:
    """A map from each hash of ``wanted`` that is in the list to how often it is."""
    if not wanted:
        return F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<int>"))

    def runs(s: Column) -> Column:
        # The runs of a sorted list are the counts.
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
        return _let(starts, lambda t: F.map_from_arrays(
            F.transform(t, lambda j: F.get(s, j)), F.transform(t, lambda j, k: F.coalesce(F.get(t, k + 1), F.size(s)) - j),
        ))

    hits = F.sort_array(F.filter(h, lambda x: x.isin(wanted)))
    return _let(hits, lambda s: F.when(F.size(s) > 0, runs(s)))


def without_letters(rows: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """Takes one class of characters after the other off the text: what is left (``_rest``) and the length after each step."""
    rows = rows.withColumn("_rest", F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")).withColumn("_size0", F.length("_rest"))
    for step, pattern in enumerate(CLASSES, 1):
        rows = rows.withColumn("_rest", F.regexp_replace("_rest", pattern, "")).withColumn(f"_size{step}", F.length("_rest"))
    return rows, [f"_size{k}" for k in range(len(CLASSES) + 1)]


def class_counts(sizes: list[str]) -> list[Column]:
    return [*(F.col(a) - F.col(b) for a, b in zip(sizes, sizes[1:])), F.col(sizes[-1])]


def measured(docs: DataFrame, text: str, wanted: list[int]) -> DataFrame:
    """``docs`` with the base counts, the class counts (``_classes``) and the counts of the wanted words (``_common``)."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda line: line.rlike(WORD))
    of_words = _let(words_of(value), lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
        F.size(h).alias("n"), repeated_words(w, h).alias("again"), counts_of(h, wanted).alias("common"),
    )))
    rows, sizes = without_letters(docs.withColumn("_of_words", of_words), text)
    return rows.withColumns({
        "n_words": F.col("_of_words.n").cast("long"), "word_chars": F.col("_size0").cast("long"),
        "n_symbols": (F.length("_rest") - F.length(F.translate("_rest", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_of_words.again").cast("long"), "_common": F.col("_of_words.common"), "_classes": F.array(*class_counts(sizes)),
    }).drop("_rest", "_of_words", *sizes)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass
class References:
    """For each language: hashes and shares of its common words, and shares of the character classes."""

    languages: list[str]
    hashes: list[list[int]]
    words: list[list[float]]
    chars: list[list[float]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """References from all documents with a language; exact counts, ties among common words by the word.

    The ``MAX_LANGUAGES`` largest languages of at least ``MIN_REFERENCE_WORDS`` words get one.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows, sizes = without_letters(known.withColumn("_n", F.size(words_of(F.col("text")))), "text")
    sums = [F.sum(c).alias(f"c{k}") for k, c in enumerate(class_counts(sizes))]
    totals = (
        rows.groupBy("lang").agg(F.sum("_n").alias("n"), *sums).where(F.col("n") >= MIN_REFERENCE_WORDS)
        .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    )
    tally = (
        known.where(F.col("lang").isin([r.lang for r in totals]) if totals else F.lit(False))
        .select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    )
    # Spark keeps the rank limit in each task before the shuffle by language.
    ranked = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    best = tally.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= COMMON_WORDS).withColumn("h", F.xxhash64("word")).orderBy("lang", "rank").collect()
    found = References([], [], [], [])
    for r in sorted(totals, key=lambda r: r.lang):
        top = [b for b in best if b.lang == r.lang]
        shares = [b["count"] / r.n for b in top]
        chars = [r[f"c{k}"] for k in range(len(CLASSES) + 1)]
        found.languages.append(r.lang)
        found.hashes.append([b.h for b in top])
        found.words.append([*shares, max(0.0, 1 - sum(shares))])
        found.chars.append([c / max(1, sum(chars)) for c in chars])
    return found


def _constant(values: list, kind: str) -> Column:
    """An array of constants, of any depth; the optimizer makes it one literal."""
    inner = kind.removeprefix("array<").removesuffix(">")
    return F.array(*(_constant(v, inner) if isinstance(v, list) else F.lit(v) for v in values)).cast(kind)


def _js(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two dense histograms."""

    def part(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        side = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
        return (side(p) + side(q)) / 2

    total = F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def word_shares(common: Column, n: Column, hashes: list[int]) -> Column:
    """Shares of a language's common words in a document, and of all its other words."""
    listed = F.transform(_constant(hashes, "array<bigint>"), lambda k: F.coalesce(F.try_element_at(common, k), F.lit(0)) / n)
    return _let(listed, lambda s: F.concat(s, F.array(1 - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))))


def assess(docs: DataFrame, references: References, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, both distances and ``kept``.

    Null and empty texts have no words and fail. A distance is null where the histogram is
    too short or there is no reference, and then does not speak against the document.
    Columns with the names of new ones are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    wanted = sorted({h for some in references.hashes for h in some})
    rows = measured(docs.drop(*made), text, wanted).withColumn("base_failed", base_failed())

    def nearest(distances: list[Column]) -> Column:
        return F.least(*distances) if len(distances) > 1 else distances[0]

    chars = words = F.lit(None).cast("double")
    if references.languages:
        shares = F.transform("_classes", lambda c: c / F.col("word_chars"))
        chars = F.when(F.col("word_chars") >= MIN_CHARS_JUDGED, _let(shares, lambda s: nearest([_js(s, _constant(t, "array<double>")) for t in references.chars])))
        common = lambda h, t: _let(word_shares(F.col("_common"), F.col("n_words"), h), lambda s: _js(s, _constant(t, "array<double>")))
        each = [common(h, t) for h, t in zip(references.hashes, references.words)]
        words = F.when(F.col("n_words") >= MIN_WORDS_JUDGED, nearest(each))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.withColumns({"char_distance": chars, "word_distance": words}).withColumn("kept", ~F.col("base_failed") & near).drop("_common", "_classes")
