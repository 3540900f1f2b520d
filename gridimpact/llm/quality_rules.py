"""Quality rules: repetition and length rules, and divergence from the language's usual distributions.

Every document gets two histograms: character classes, and the most common words of its language. All documents of a
language, summed, make that language's reference. A document fails if its Jensen-Shannon distance from the reference
exceeds a limit; texts below a minimum length are not judged by distance, since short histograms scatter.
Histograms go to a small table once, so the text is read once. DataFrame expressions only.

Defined results: null and empty texts have no words and fail the base rule (n_words < 10); languages without a word list
(null included) share one reference and are judged by character classes alone; repeated rows are separate rows; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import GAP, let, text_or_empty, written

#: Frequent function words.
COMMON_WORDS: dict[str, list[str]] = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ein", "des", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
OTHER = "other"
#: Character classes as ranges of a bracket expression; the rest is a class of its own.
CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r"!-/:-@\[-`{-~")
N_WORDS = 12


def _dropped(text: Column, pattern: str) -> Column:
    """Code points that match."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that occur twice or more in the array; the words column must be a named one."""
    n = F.size(words)
    gram = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(width)))
    code = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)))
    at = F.sequence(F.lit(0), n - width)
    codes = F.transform(at, code)
    placed = F.array_sort(F.transform(at, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
    return (
        F.when(n < width, F.lit(0))
        .when(F.size(F.array_distinct(codes)) == n - width + 1, F.lit(0))  # equal windows have equal codes
        .otherwise(let(placed, lambda p: let(_twins(p), lambda t: _covered(t, width))))
    )


def _twins(placed: Column) -> Column:
    """Places of the windows that have an equal, in order; placed: windows in order of (text, place)."""
    same = lambda s, k: s["g"].eqNullSafe(F.get(placed, k)["g"])
    marked = F.transform(placed, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"]))
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def _covered(starts: Column, width: int) -> Column:
    """Places covered by windows of `width` that begin at the sorted starts."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, i: F.struct(
        (acc["n"] + i + width - F.greatest(i, acc["to"])).alias("n"), (i + width).alias("to")
    )
    return F.aggregate(starts, begin, step, lambda acc: acc["n"])


def histograms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms of each document."""
    lang = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(OTHER)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), lang.alias("lang"))
    rows = rows.withColumns({"words": _words(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    plain = F.concat(F.lit(" "), F.lower(F.regexp_replace("text", r"[^\p{L}]+", "  ")), F.lit(" "))
    rows = rows.withColumn("plain", plain)
    lists = reduce(lambda c, k: c.when(F.col("lang") == k, F.array(*map(F.lit, COMMON_WORDS[k]))), COMMON_WORDS, F)
    rows = rows.withColumn("list", lists)

    def hits(k: int) -> Column:
        needle = F.concat(F.lit(" "), F.get("list", F.lit(k)), F.lit(" "))
        return F.coalesce((F.octet_length("plain") - F.octet_length(F.replace("plain", needle, F.lit("")))) / F.octet_length(needle), F.lit(0)).cast("long")

    def whole(parts: list[Column], total: Column) -> Column:
        """The parts and what remains of the total."""
        return let(F.array(*parts), lambda x: F.concat(x, F.array(F.greatest(total - _total(x), F.lit(0).cast("long")))))

    n_words = F.size("words").cast("long")
    return rows.select(
        "id", "lang", n_words.alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        _dropped(F.col("text"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        whole([_dropped(F.col("text"), f"[{c}]+").cast("long") for c in CLASSES], F.length("text").cast("long")).alias("classes"),
        whole([hits(k) for k in range(N_WORDS)], n_words).alias("common"),
    )


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1, of two histograms of counts; null if either is empty."""
    share = lambda xs: let(_total(xs), lambda t: F.transform(xs, lambda x: x / F.nullif(t, F.lit(0))))
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda x, y: half(x, y) + half(y, x))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((_total(p) > 0) & (_total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    max_class_distance: float = 0.30,
    max_word_distance: float = 0.35,
    min_words_class: int = 30,
    min_words_word: int = 100,
) -> DataFrame:
    """id, the base counts, base_failed, the two distances and kept, for every document."""
    rows = written(histograms(docs, id_col), "histograms")
    summed = lambda name, n: F.array(*(F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)) for k in range(n)))
    reference = rows.groupBy("lang").agg(summed("classes", len(CLASSES) + 1).alias("r_classes"), summed("common", N_WORDS + 1).alias("r_common"))
    rows = rows.join(F.broadcast(reference), "lang")  # a row for each language with a list, and one for the others
    rows = rows.withColumns({"class_distance": js_distance(F.col("classes"), F.col("r_classes")), "word_distance": js_distance(F.col("common"), F.col("r_common"))})
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = ((F.col("n_words") >= min_words_class) & (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)) | (
        (F.col("n_words") >= min_words_word) & (F.col("lang") != OTHER) & (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    )
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~odd).alias("kept"), "class_distance", "word_distance",
    )
