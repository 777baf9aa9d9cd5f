"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets the counts of the base rules and two histograms: its
characters by class and its words by common word. The references are the pooled
histograms of each language over all documents that pass the base rules. A
document fails when the Jensen-Shannon distance to its language's reference is
too large; documents shorter than the guards are not judged by a histogram.

How far a text without common words lies from its reference depends on their
share in the language (0.35 at a quarter), and chance alone takes a short text
further than a long one. So each language and length, by powers of two, has a
word limit of its own: the median distance of the documents that pass the base
rules, plus a multiple of the median absolute deviation, within two fixed
bounds. A length with few documents has the limit of its whole language.

Null or empty texts have no words: every count is 0 and the base rules fail.
Null languages form a language of their own. A language with few documents is
held against the reference of all languages together. Texts of any length are
counted whole. Rows that share an id, or have a null one, are judged each for
itself, and repeated rows count in the references as often as they occur. An
empty table gives an empty table. Columns beyond id, text and language are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"

# Common function words of the languages whose references are kept.
COMMON = {
    "en": "the of and to in that is was for with on as at be by it from or an this",
    "fr": "de la le et les des en un une que est pour dans par sur au avec du il qui",
    "de": "der die und das ist von den mit ein eine zu auf in für sich nicht dem es im auch",
    "es": "de la que el en y los las del se por un una con para al lo es su como",
}
#: Punctuation of prose, inside a character class.
COMMON_MARKS = r""".,;:!?'"()\-"""


@dataclass(frozen=True)
class Limits:
    """min_chars and min_words guard the two distances; a reference needs min_docs documents, and so does a spread.

    The word limit is the median and word_spreads deviations, but at least
    min_word_limit, so that many copies of one text do not narrow it, and at
    most max_word_distance, which also holds where there is no spread.
    """

    max_char_distance: float = 0.30
    max_word_distance: float = 0.55
    min_word_limit: float = 0.25
    word_spreads: float = 4.0
    min_chars: int = 300
    min_words: int = 80
    min_docs: int = 30


def common_words() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def text_counts(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row per document: the base counts and both histograms."""
    text = F.col("_text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.select("*", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    words, n = F.col("_words"), F.size("_words")
    grams = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    common = common_words()
    hits = F.filter(F.transform(words, F.lower), lambda w: w.isin(common))
    df = df.select(
        "doc_id", "_lang", "_text",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_windows"),
        F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")).alias("_hits"),
    )
    # Sorted, equal windows are neighbours; most texts have none.
    w = F.col("_windows")
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_grams", F.when(F.size(F.array_distinct(w)) < F.size(w), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_windows")
    g = F.col("_grams")
    twice = F.filter(g, lambda x, j: (x["h"] == F.get(g, j - 1)["h"]) | (x["h"] == F.get(g, j + 1)["h"]))
    total = F.length(text)
    df = df.select(
        "doc_id", "_lang", "n_words", "word_chars", "n_dup_lines", "_hits",
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_twice"),
        (total - _without(text, r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (total - _without(text, r"\p{Lu}+")).cast("long").alias("_upper"),
        (total - _without(text, r"\p{Ll}+")).cast("long").alias("_lower"),
        (total - _without(text, r"[0-9]+")).cast("long").alias("_digits"),
        (total - _without(text, f"[{COMMON_MARKS}]+")).cast("long").alias("_marks"),
        (total - F.col("word_chars")).cast("long").alias("_space"),
        total.cast("long").alias("_total"),
    )
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    covered = F.aggregate(
        "_twice", state, lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).cast("long").alias("n"), (i + 3).cast("int").alias("end")), lambda s: s["n"]
    )
    h = F.col("_hits")
    seen = [((F.length(h) - F.length(F.replace(h, F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long") for w in common]
    classes = [F.col(c) for c in ("_upper", "_lower", "_digits", "_marks", "n_symbols", "_space")]
    rest = F.greatest(F.col("_total") - sum(classes[1:], classes[0]), F.lit(0))
    return df.select("doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), F.array(*classes, rest).alias("_chars"), F.array(*seen).alias("_common")).select(
        "*", F.array_append("_common", F.greatest(F.col("n_words") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))).alias("_bins")
    ).drop("_common")


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(counts, lambda x: F.try_divide(x.cast("double"), total))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; 0 to 1."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def _pooled(rows: DataFrame, by: list[str], n_chars: int, n_bins: int) -> DataFrame:
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("_bins")[i]).alias(f"b{i}") for i in range(n_bins)]
    return rows.groupBy(*by).agg(F.count("*").alias("_docs"), *sums).select(
        *by, "_docs",
        _share(F.array(*[F.col(f"c{i}") for i in range(n_chars)])).alias("_ref_chars"),
        _share(F.array(*[F.col(f"b{i}") for i in range(n_bins)])).alias("_ref_bins"),
    )


def _fixed(values: list[float | None]) -> Column:
    return F.array(*[F.lit(v).cast("double") for v in values])


#: Texts of 1,024 words and more are one band.
TOP_BAND = 10


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def word_limits(scored: DataFrame, limits: Limits) -> DataFrame:
    """_key, _band, _word_limit: from the distances in steps of 0.0001, so a band has 10,001 rows at most. Band 0 is the whole language."""
    near = scored.where(~F.col("base_failed") & F.col("word_distance").isNotNull())
    steps = near.groupBy("_key", "_band", F.round(F.col("word_distance") * 10_000).cast("long").alias("_step")).agg(F.count("*").alias("_n"))
    steps = steps.select("_key", F.explode(F.array(F.lit(0), "_band")).alias("_band"), "_step", "_n")
    by = ["_key", "_band"]
    middle = steps.groupBy(*by).agg(F.percentile("_step", 0.5, F.col("_n")).alias("_median"), F.sum("_n").alias("_judged"))
    spread = steps.join(middle, by).groupBy(*by, "_median", "_judged").agg(F.percentile(F.abs(F.col("_step") - F.col("_median")), 0.5, F.col("_n")).alias("_spread"))
    limit = (F.col("_median") + limits.word_spreads * F.col("_spread")) / 10_000
    return spread.where(F.col("_judged") >= limits.min_docs).select(*by, F.least(F.greatest(limit, F.lit(limits.min_word_limit)), F.lit(limits.max_word_distance)).alias("_word_limit"))


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Counts, both distances and the verdict of every document, one row each.

    The per-document counts are written once; the references come from all of
    them. References and word limits are a few rows a language; they are written
    as tables, whose size Spark then knows, so that it broadcasts them if they are
    small and does not deal the documents out by language. The word limits come
    from all distances, so those are written once too; languages without a
    reference of their own share one limit.
    """
    counts = stored(text_counts(docs, id_col, text_col, lang_col).withColumn("base_failed", base_failed()))
    n_chars, n_bins = 7, len(common_words()) + 1
    good = counts.where(~F.col("base_failed"))
    by_lang = stored(_pooled(good, ["_lang"], n_chars, n_bins).where(F.col("_docs") >= limits.min_docs).drop("_docs"))
    overall = _pooled(good, [], n_chars, n_bins).first()  # one row of fixed width, whatever the input
    joined = counts.join(by_lang, "_lang", "left").withColumns({
        "_band": F.least(F.floor(F.log2(F.greatest("n_words", F.lit(2)))), F.lit(TOP_BAND)).cast("int"),
        "_key": F.when(F.col("_ref_bins").isNotNull(), F.concat(F.lit("="), F.col("_lang"))).otherwise(""),
        "_ref_chars": F.coalesce("_ref_chars", _fixed(overall["_ref_chars"])),
        "_ref_bins": F.coalesce("_ref_bins", _fixed(overall["_ref_bins"])),
    })
    long_enough = F.col("word_chars") >= limits.min_chars, F.col("n_words") >= limits.min_words
    char_d = F.when(long_enough[0], js_distance(_share(F.col("_chars")), F.col("_ref_chars")))
    word_d = F.when(long_enough[1], js_distance(_share(F.col("_bins")), F.col("_ref_bins")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance"]
    scored = stored(joined.select("_key", "_band", *columns[:-2], char_d.alias("char_distance"), word_d.alias("word_distance")))
    found = stored(word_limits(scored, limits))  # at most 11 rows a language
    whole = found.where("_band = 0").select("_key", F.col("_word_limit").alias("_whole_limit"))
    judged = scored.join(found, ["_key", "_band"], "left").join(whole, "_key", "left")
    word_limit = F.coalesce("_word_limit", "_whole_limit", F.lit(limits.max_word_distance))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return judged.select(*columns, (~F.col("base_failed") & near).alias("kept"))
