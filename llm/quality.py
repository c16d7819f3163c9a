"""Quality rules with Spark functions only: simple counts, and how far a text is from its language.

Each text gets two histograms: code points by class, and words by the common words of each language. The common
words of a language are the ``COMMON`` most frequent words with a letter of all its rows. A reference is the sum of the histograms
of all rows of a language; every language has one. The Jensen-Shannon distance (square root of the divergence, base
2, from 0 to 1) of a text is its smallest over all references, so a wrong or missing language label does no harm.

A text without any common word has a distance that only depends on the share c of the common words in the reference,
sqrt((log2(2 / (2 - c)) + c + (1 - c) log2((2 - 2c) / (2 - c))) / 2), 0.31 at c = 0.18 and 0.41 at c = 0.30. So the
bounds of the word distance are shares of this ``bare`` distance: a text is too far if it is as good as without the
common words of each language. Short texts have noisy histograms: below ``min_chars`` and ``min_words`` the
distances are null and never speak against a text.

Defined results: a null or empty text has no words, fails the base rules and is not kept; with no labelled
language there is no reference and only the base rules decide; repeated rows get equal results; other
columns are kept (columns of the names of the results are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.chat import let
from llm.common import free_name, spread, stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "other")

#: How many of the most frequent words of a language are its common words.
COMMON = 16

#: Too far by one histogram alone, or by both at once; the word distance as a share of that of a text without common words.
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_SHARE = 0.95
MAX_BOTH = (0.125, 0.77)
MIN_CHARS = 200
MIN_WORDS = 60


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = COMMON) -> DataFrame:
    """lang, word, share: the most frequent words of each language, and their share of all its words."""
    each = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(words_of(F.col(text_col))).alias("word"))
    counts = stored(each.groupBy("lang", "word").agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # lists and tables repeat their marks, so a common word has a letter
    first = counts.filter(F.col("word").rlike(r"\p{L}")).withColumn("rank", rank).filter(F.col("rank") <= most)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return stored(first.join(total, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share")))


def measure(docs: DataFrame, common: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and word_counts (of all ``common`` words)."""
    names = [free_name(docs, n) for n in ("the_text", "the_words", "the_hashes", "the_windows", "the_rest", "the_common")]
    own_text, own_words, own_hashes, own_windows, own_rest, own_common = names
    text = F.col(own_text)
    listed = sorted(r[0] for r in common.select("word").distinct().collect())
    out = docs.withColumn(own_text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(own_words, words_of(text))
    out = out.withColumns(
        {
            own_hashes: F.transform(own_words, lambda w: F.xxhash64(w)),
            own_rest: F.regexp_replace(text, r"\p{L}+", ""),
            own_common: F.filter(own_words, lambda w: w.isin(*listed)) if listed else F.array().cast("array<string>"),
        }
    )
    hashed = F.col(own_hashes)
    out = out.withColumn(
        own_windows,
        F.when(
            F.size(hashed) >= 5,
            F.transform(F.sequence(F.lit(0), F.size(hashed) - 5), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(5)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = F.col(own_rest)
    left = lambda pattern: F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))
    letters = F.length(text) - F.length(rest)
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    digit, space, point = left(r"\p{Nd}+"), left(SPACE + "+"), left(r"""[.,;:!?'"()\-]+""")
    n_common = F.size(own_common)
    out = out.withColumns(
        {
            "n_words": F.size(own_words).cast("long"),
            "word_chars": F.length(F.array_join(own_words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.when(
                F.size(F.array_distinct(own_windows)) < F.size(own_windows), repeated_words(F.col(own_windows))
            ).otherwise(0).cast("long"),
            "classes": F.array(letters - upper, upper, digit, space, point, F.length(rest) - digit - space - point).cast("array<double>"),
            "word_counts": F.map_from_entries(
                F.transform(F.array_distinct(own_common), lambda w: F.struct(w.alias("word"), (n_common - F.size(F.array_remove(own_common, w))).cast("double").alias("n")))
            ),
        }
    )
    return out.drop(*names)


def repeated_words(windows: Column) -> Column:
    """How many words stand in 5-word windows that occur twice or more."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    return let(
        order,
        lambda s: let(
            F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1))),
                    lambda x: x["i"],
                )
            ),
            # each window adds the words up to the next one, five at most
            lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))), F.lit(0), lambda n, x: n + x),
        ),
    )


def references(measured: DataFrame, common: DataFrame, lang_col: str = "lang") -> DataFrame:
    """lang, classes, words, shares and bare of each language: the shares of all its rows (those of the words with the rest
    as the last), and the distance of a text without any of the words."""
    known = measured.filter(F.col(lang_col).isNotNull() & (F.col("n_words") > 0))
    sums = known.groupBy(F.col(lang_col).alias("lang")).agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))])
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    classes = sums.select("lang", F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES))]).alias("classes"))
    words = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("share", "word")), asc=False).alias("w"))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate("w.share", F.lit(0.0), lambda s, c: s + c))
    words = words.select("lang", F.col("w.word").alias("words"), F.concat("w.share", F.array(rest)).alias("shares"))
    none = F.concat(F.transform("words", lambda _: F.lit(0.0)), F.array(F.lit(1.0)))
    return classes.join(words.withColumn("bare", js_distance(none, F.col("shares"))), "lang")


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance between counts (made shares here) and the reference shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def of(total):
        each = F.zip_with(
            counts,
            reference,
            lambda c, q: let(F.struct((c / total).alias("p"), ((c / total + q) / 2).alias("m")), lambda x: part(x["p"], x["m"]) + part(q, x["m"])),
        )
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2))

    return let(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c), of)


def judge(
    measured: DataFrame, refs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_SHARE, max_both: tuple[float, float] = MAX_BOTH, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS
) -> DataFrame:
    """``measured`` plus class_distance, word_distance, base_failed and kept. The references of all languages are one small row for each task."""
    own_refs, own_words, own_share = (free_name(measured, n) for n in ("the_refs", "the_distances", "the_share"))
    n = F.col("n_words")
    row = refs.agg(F.collect_list(F.struct("classes", "words", "shares", "bare")).alias(own_refs))
    out = measured.crossJoin(F.broadcast(row))

    def by_words(r):
        counts = F.transform(r["words"], lambda w: F.coalesce(F.element_at("word_counts", w), F.lit(0.0)))
        whole = let(counts, lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))
        return let(js_distance(whole, r["shares"]), lambda d: F.struct(d.alias("distance"), (d / r["bare"]).alias("share")))

    total = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c)
    out = out.withColumn(own_words, F.when(n >= min_words, F.transform(own_refs, by_words)))
    out = out.withColumns(
        {
            "class_distance": F.when(total >= min_chars, F.array_min(F.transform(own_refs, lambda r: js_distance(F.col("classes"), r["classes"])))),
            "word_distance": F.array_min(F.col(own_words)["distance"]),
            own_share: F.coalesce(F.array_min(F.col(own_words)["share"]), F.lit(0.0)),
            "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
        }
    )
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.col(own_share)
    far = (by_class > max_class) | (by_word > max_word) | ((by_class > max_both[0]) & (by_word > max_both[1]))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop(own_refs, own_words, own_share)


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with counts, distances and verdict. The counts are stored once, the references come from all rows."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    common = common_words(spread(docs), text_col, lang_col)
    measured = stored(measure(spread(docs), common, text_col))
    return judge(measured, references(measured, common, lang_col)).select(
        *[f"`{c}`" for c in docs.columns if c not in (*counts, "base_failed", "kept", "class_distance", "word_distance", "classes", "word_counts")],
        *counts, "class_distance", "word_distance", "base_failed", "kept",
    )
