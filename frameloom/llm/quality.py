"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are compared
with those of its language by Jensen-Shannon distance. The common words of a
language are learned: its ``TOP`` most frequent words, as written between white
space, ties by code point. The
reference histograms are sums over the language's documents (of characters, over
those that pass the base rule), plus ``PRIOR`` characters or words that are spread
as over all languages. So the little text of a rare language is drawn towards all
text, by as much as it is little, and nothing is switched at some size. Counts
that any such filter starts from (words, symbols, repeated lines and word
windows) are computed too.

Defined cases: a null or empty text has no words, counts of 0, and fails the
base rule; a null language is a language of its own. Texts below the minimum
lengths pass the divergence rules, as their histograms say little. Repeated
rows each get a row, ids are not looked at, and columns other than the three named
are not read. An empty table gives an empty result. Documents with one window
repeated throughout take n log n steps, not a product.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.shared import LOWER, UPPER, words, written

#: The character classes of ASCII; what is left of it, and
#: everything beyond ASCII, are two more.
CLASSES = {
    "lower": LOWER,
    "upper": UPPER,
    "space": " \t\n\x0b\x0c\r",
    "stop": ".,",
    "digit": "0123456789",
    "mark": "!?;:'\"()-",
}
#: Common words of a language, and the prior of its histograms.
TOP, PRIOR = 32, 10_000.0
#: A word that is common has at least one in so many of its language's words.
#: Fewer than these can, so few words are left to rank.
RARE = 2000
#: Languages become broadcast rows up to this number.
BROADCAST_LANGUAGES = 10_000
WINDOW = 5


def chained(a: str, b: str, by: int) -> Column:
    """Of each place, one hash of its ``a`` and of the ``b`` that lies ``by`` later.
    The last ``by`` places have nothing to meet and are to be cut by the caller."""
    later = F.slice(b, by + 1, F.greatest(F.size(b), F.lit(1)))
    return F.zip_with(a, later, lambda x, y: F.xxhash64(x, y))


def paired(windows: Column) -> Column:
    """(hash, place) of each window, sorted, so that equal windows are neighbours."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(pairs: Column) -> Column:
    """The places, in order, of windows that equal a neighbour."""
    hit = F.transform(
        pairs,
        lambda x, k: F.when((x.h == F.get(pairs, k - 1).h) | (x.h == F.get(pairs, k + 1).h), x.i),
    )
    return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))


def covered_words(places: Column) -> Column:
    """Words in the windows at these places: their lengths less what overlaps."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s.n + i + WINDOW - F.greatest(s.end, i)).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s.n,
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; 0 if one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    a, b = total(p), total(q)
    terms = F.zip_with(p, q, lambda x, y: F.struct((x / a).alias("x"), (y / b).alias("y")))
    divergence = F.aggregate(
        terms,
        F.lit(0.0),
        lambda s, t: s + (part(t.x, (t.x + t.y) / 2) + part(t.y, (t.x + t.y) / 2)) / 2,
    )
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common, longest, ref_common) from rows (lang, text): the most frequent
    words of each language, the bytes of the longest, and their smoothed counts, with
    that of all others last."""
    counts = written(
        docs.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")),
        "word-counts",
    )
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    everything = F.lit(float(totals.agg(F.sum("total")).first()[0] or 1))
    c, t = counts.alias("c"), totals.alias("t")
    often = c.join(t, F.col("c.lang").eqNullSafe(F.col("t.lang"))).where(F.col("n") * RARE >= F.col("total"))
    # Fewer than RARE rows for each language are ranked.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = written(often.select("c.lang", "word", "n", "total").withColumn("place", place).where(F.col("place") <= TOP), "common-words")
    pooled = counts.join(top.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("pooled"))
    smooth = F.col("n") + PRIOR * F.col("pooled") / everything
    listed = top.join(pooled, "word").groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("place", "word", smooth.alias("n")))).alias("found"), F.max("total").alias("total")
    )
    known = F.aggregate("found", F.lit(0.0), lambda s, x: s + x.n)
    return listed.select(
        "lang",
        F.transform("found", lambda x: x.word).alias("common"),
        F.array_max(F.transform("found", lambda x: F.octet_length(x.word))).alias("longest"),
        F.concat(F.transform("found", lambda x: x.n), F.array(F.col("total") + PRIOR - known)).alias("ref_common"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each row (doc_id, lang, text, common, longest); no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # A language whose texts have no words has no list, and no histogram of it.
    # Most words are longer than any common one and need no look at the list.
    known = F.filter("w", lambda x: (F.octet_length(x) <= F.col("longest")) & F.array_contains("common", x))
    out = docs.withColumn("w", words(F.col("text"))).select(
        "doc_id",
        "lang",
        F.length("text").alias("chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size("w").alias("n"),
        F.array_join("w", "").alias("solid"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        "common",
        F.concat(F.lit("|"), F.array_join(known, "||"), F.lit("|")).alias("hits"),
    )
    # What separates words is all white space. Each other class is taken out of
    # what is left, so every step reads less.
    left, counts = F.col("solid"), []
    for name, characters in CLASSES.items():
        if name == "space":
            counts.append(F.col("chars") - F.length("solid"))
            continue
        rest = F.regexp_replace(left, f"[{re.escape(characters)}]+", "")
        counts.append(F.length(left) - F.length(rest))
        left = rest
    beyond = F.length(F.regexp_replace(left, r"[\x00-\x7F]+", ""))
    counts += [F.length(left) - beyond, beyond]
    # Symbols are in none of the classes, so they are looked for in what those leave.
    symbols = F.length(left) - F.length(F.translate(left, "#*$%&|<>", ""))

    def times(word: Column) -> Column:
        mark = F.concat(F.lit("|"), word, F.lit("|"))
        return (F.length("hits") - F.length(F.replace("hits", mark, F.lit("")))) / F.length(mark)

    # Hashes of one word, then of 2, 4 and 5 words from the same place on.
    out = out.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.array(*counts).cast("array<double>").alias("char_counts"),
        F.transform("common", times).alias("times"),
        "n",
        "h",
        chained("h", "h", 1).alias("h2"),
    )
    out = out.withColumn("h4", chained("h2", "h2", 2)).drop("h2")
    whole = F.slice(chained("h4", "h", 4), 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0)))
    out = out.withColumn("windows", whole).drop("n", "h", "h4")
    # Most documents repeat no window, and only the others go on to sort them.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("pairs", F.when(repeats, paired(F.col("windows")))).drop("windows")
    out = out.withColumn("places", repeated_places(F.col("pairs"))).drop("pairs")
    out = out.withColumn("n_repeat_words", F.coalesce(covered_words(F.col("places")), F.lit(0)).cast("long"))
    others = F.col("n_words") - F.aggregate("times", F.lit(0.0), lambda s, x: s + x)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumns({"common_counts": F.coalesce(F.concat("times", F.array(others)), F.array().cast("array<double>")), "base_failed": base}).drop("places", "times")


def rate_quality(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most_char_distance: float = 0.25,
    most_word_distance: float = 0.35,
    least_chars: int = 200,
    least_words: int = 50,
) -> DataFrame:
    """One row per document: the counts, both distances, base_failed, kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), body.alias("text"))
    learned = written(common_words(own).withColumnRenamed("lang", "ref_lang"), "common-words")
    same = F.col("lang").eqNullSafe(F.col("ref_lang"))
    few = learned.count() <= BROADCAST_LANGUAGES

    def of_language(references: DataFrame) -> DataFrame:
        return F.broadcast(references) if few else references

    listed = own.join(of_language(learned.select("ref_lang", "common", "longest")), same, "left").drop("ref_lang")
    facts = written(measured(listed), "quality")

    n_chars = len(CLASSES) + 2
    by_lang = facts.groupBy(F.col("lang").alias("char_lang")).agg(
        F.array(
            *[F.coalesce(F.sum(F.when(~F.col("base_failed"), F.get("char_counts", i))), F.lit(0.0)) for i in range(n_chars)]
        ).alias("char_sums")
    )
    by_lang = written(by_lang, "references")
    pooled = by_lang.agg(*[F.coalesce(F.sum(F.get("char_sums", i)), F.lit(0.0)) for i in range(n_chars)]).first()
    prior = F.array(*[F.lit(PRIOR * x / (sum(pooled) or 1.0)) for x in pooled])
    smooth = by_lang.select("char_lang", F.zip_with("char_sums", prior, lambda a, b: a + b).alias("ref_chars"))
    judged = (
        facts.join(of_language(smooth), F.col("lang").eqNullSafe(F.col("char_lang")), "left")
        .join(of_language(learned.select("ref_lang", "ref_common")), same, "left")
        .withColumns(
            {
                "char_distance": distance(F.col("char_counts"), F.col("ref_chars")),
                "word_distance": F.coalesce(distance(F.col("common_counts"), F.col("ref_common")), F.lit(0.0)),
            }
        )
    )
    chars = F.aggregate("char_counts", F.lit(0.0), lambda s, v: s + v)
    alike = ((chars < least_chars) | (F.col("char_distance") <= most_char_distance)) & (
        (F.col("n_words") < least_words) | (F.col("word_distance") <= most_word_distance)
    )
    return judged.withColumn("kept", ~F.col("base_failed") & alike).drop(
        "ref_lang", "char_lang", "ref_chars", "ref_common", "char_counts", "common_counts"
    )
