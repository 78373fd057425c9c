"""Quality rules: base rules, then distribution divergence by language.

A document's histogram of character classes and of common words (in lower case,
standing alone) is compared
with its language's reference by Jensen-Shannon distance (base 2, 0 to 1).
The references are gathered from the whole corpus: per language, the median
share of each class over all documents that pass the base rules (medians, so that
less than half of junk does not move them), scaled to sum to 1.

Only DataFrame functions are used. Scale: every document is judged from its
own row; no document text is shuffled. The references are one row for each
listed language (and one for all others), gathered by a partial aggregate.

Guards: the character distance counts from `min_chars` code points on, the
word distance from `min_words` words on; shorter histograms are too noisy, and
the limits are wider the shorter a text is.

Defined cases: a null or empty text has no words and fails the base rules. A
language that is null or not listed is compared with the reference of all
such documents, by the common words of all listed languages. A corpus without
documents for a reference leaves the distance 0. Extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITE_TEXT, constant, fresh, stored

#: Common words by language (fixed values).
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los"],
}

#: Largest distances that are kept: a limit for long texts, and what a text of
#: n words may have above it (divided by n), as short histograms are noisier.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.16, 7.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.24, 10.0
#: Shorter texts are not compared.
MIN_CHARS, MIN_WORDS = 200, 100

#: Windows found twice that are searched for one by one.
FEW = 48

CHAR_CLASSES = ("lower", "upper", "digit", "white", "symbol", "other")


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, and the two histograms (chars and words, counts as doubles);
    `prefix` keeps the new names apart from those of docs."""
    p = lambda name: f"{prefix}{name}"
    text, words = p("text_"), p("words_")
    length = lambda c: F.char_length(c).cast("long")
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    blanked = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), WHITE_TEXT[1:], F.col(text))
    out = out.withColumn(words, F.array_remove(F.split(blanked, " "), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(WHITE_TEXT))) > 0)
    # lower-case letters and white space go first: the later counts see what is left
    out = out.withColumns({
        p("n_words"): F.size(words).cast("long"),
        p("word_chars"): length(F.array_join(words, "")),
        p("rest_"): F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", ""),
        p("full_"): length(F.col(text)),
        p("lines_"): lines,
        # 64-bit hashes of the three-word windows, by position
        p("windows_"): F.when(F.size(words) >= 4, F.transform(F.slice(F.arrays_zip(words, F.slice(words, 2, F.size(words)), F.slice(words, 3, F.size(words))), 1, F.size(words) - 2), lambda w: F.xxhash64(w))),
    })
    rest = p("rest_")
    without = lambda pattern: length(F.col(rest)) - length(F.regexp_replace(rest, pattern, ""))
    windows = F.col(p("windows_"))
    out = out.withColumns({
        p("n_symbols"): without(r"[#*$%&|<>]+"),
        p("upper_"): without(r"\p{Lu}+"),
        p("digit_"): without(r"\p{Nd}+"),
        p("left_"): length(F.col(rest)),
        p("n_dup_lines"): (F.size(p("lines_")) - F.size(F.array_distinct(p("lines_")))).cast("long"),
        p("sorted_"): F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(windows)),
    })
    ordered = F.col(p("sorted_"))
    out = out.withColumn(p("pairs_"), F.arrays_zip(ordered.alias("a"), F.slice(ordered, 2, F.size(ordered)).alias("b")))
    twice = F.array_distinct(F.transform(F.filter(p("pairs_"), lambda x: x["a"] == x["b"]), lambda x: x["a"]))
    out = out.withColumn(p("twice_"), twice)
    # positions of the windows found twice: by search among a few such windows,
    # and by a sort of all windows with their positions where they are many
    found = F.filter(F.transform(windows, lambda w, i: F.when(F.array_contains(p("twice_"), w), i)), lambda i: i.isNotNull())
    many = F.size(p("twice_")) > FEW
    out = out.withColumn(p("placed_"), F.when(many, F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    s = F.col(p("placed_"))
    again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)))
    out = out.withColumn(p("at_"), F.when(many, F.sort_array(F.transform(again, lambda x: x["i"]))).otherwise(found))
    at = F.col(p("at_"))
    steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3).cast("long"), lambda a, b: a + b))
    out = out.withColumn(p("n_repeat_words"), F.coalesce(covered, F.lit(0).cast("long")))
    n = F.col(p("n_words"))
    white = F.col(p("full_")) - F.col(p("word_chars"))
    lower = F.col(p("full_")) - F.col(p("left_")) - white
    other = F.col(p("left_")) - F.col(p("upper_")) - F.col(p("digit_")) - F.col(p("n_symbols"))
    counts = [lower, F.col(p("upper_")), F.col(p("digit_")), white, F.col(p("n_symbols")), other]
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = out.withColumns({
        p("base_failed"): (n < 50) | (100 * F.col(p("n_repeat_words")) > 50 * n),
        p("chars"): F.array(*(c.cast("double") for c in counts)),
        p("group"): F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other")),
    })
    listed = {**COMMON, "other": sorted({w for ws in COMMON.values() for w in ws})}
    words_of = F.element_at(constant(listed, "map<string,array<string>>"), F.col(p("group")))
    out = out.withColumn(p("common_"), F.transform(words_of, lambda w: (F.size(words) - F.size(F.array_remove(words, w))).cast("double")))
    rest_words = F.greatest(n.cast("double") - F.aggregate(p("common_"), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    out = out.withColumn(p("common"), F.concat(F.col(p("common_")), F.array(rest_words)))
    return out.drop(*(p(x) for x in ("text_", "words_", "rest_", "lines_", "full_", "upper_", "digit_", "left_", "windows_", "sorted_", "pairs_", "twice_", "placed_", "at_", "common_")))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))


def references(rows: DataFrame, prefix: str = "") -> dict[str, tuple[list[float] | None, list[float] | None]]:
    """The median histograms by language group: one row each for the listed
    languages and for all others comes to the driver, whatever the corpus."""
    p = lambda name: f"{prefix}{name}"
    widths = {**{k: len(v) + 1 for k, v in COMMON.items()}, "other": len({w for ws in COMMON.values() for w in ws}) + 1}
    good = rows.where(~F.col(p("base_failed"))).select(F.col(p("group")).alias("g"), _shares(F.col(p("chars"))).alias("c"), _shares(F.col(p("common"))).alias("w"))
    wide = max(widths.values())
    got = good.groupBy("g").agg(*(F.percentile_approx(F.get("c", F.lit(i)), 0.5).alias(f"c{i}") for i in range(len(CHAR_CLASSES))), *(F.percentile_approx(F.get("w", F.lit(i)), 0.5).alias(f"w{i}") for i in range(wide))).collect()
    whole = lambda xs: [x / sum(xs) for x in xs] if None not in xs and sum(xs) > 0 else None
    return {r.g: (whole([r[f"c{i}"] for i in range(len(CHAR_CLASSES))]), whole([r[f"w{i}"] for i in range(widths[r.g])])) for r in got}


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts and a reference."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(_shares(counts), reference, lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y), F.lit(0.0)))


def judged(rows: DataFrame, refs: dict[str, tuple[list[float] | None, list[float] | None]], prefix: str = "", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """rows with char_distance, word_distance and kept."""
    p = lambda name: f"{prefix}{name}"

    def against(counts: str, which: int) -> Column:
        known = {g: ref[which] for g, ref in refs.items() if ref[which]}
        ref = F.try_element_at(constant(known, "map<string,array<double>>"), F.col(p("group")))
        return F.when(ref.isNotNull(), distance(F.col(p(counts)), ref)).otherwise(F.lit(0.0))

    chars = F.aggregate(p("chars"), F.lit(0.0), lambda a, b: a + b)
    out = rows.withColumns({p("char_distance"): F.when(chars >= min_chars, against("chars", 0)).otherwise(0.0), p("word_distance"): F.when(F.col(p("n_words")) >= min_words, against("common", 1)).otherwise(0.0)})
    n = F.greatest(F.col(p("n_words")), F.lit(1))
    return out.withColumn(p("kept"), ~F.col(p("base_failed")) & (F.col(p("char_distance")) <= max_char + CHAR_SLACK / n) & (F.col(p("word_distance")) <= max_word + WORD_SLACK / n))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, the distances and kept; one row for
    each row of docs."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))).drop("text", "lang")
    rows = stored(rows, "quality-counts")
    return judged(rows, references(rows)).drop("group", "chars", "common")


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    prefix = fresh([c[:2] for c in docs.columns], "q_")
    # written once with their counts: the counts cost more than the text's disk
    rows = stored(measured(docs, text_col, lang_col, prefix), "quality-rows")
    return judged(rows, references(rows, prefix), prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)
