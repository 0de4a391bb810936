"""Quality rules: counting rules, then the divergence of a document from language references.

A document's histograms of character classes and of common words are held against the same
histograms of each language, summed over the whole corpus, by Jensen-Shannon distance. A document is
judged by its closest language, so a wrong or missing language mark does no harm. A histogram
over too little text says nothing, so each distance has a least length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import SPACE, TMP, let, words
from topiclog.llm.components import cut

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "was", "with", "on", "it", "as", "be", "by", "this", "from", "or", "are", "an", "at"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "plus", "ne", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo", "como"],
}
#: Patterns of character classes, each taken out of what the ones before leave; the rest is a class too.
CLASSES = [r"\p{Ll}+", r"\s+", r"\p{Lu}+", r"\p{N}+", r"[.,;:!?'\"()-]+", r"[\p{L}\p{M}]+"]
SYMBOLS = r"[#*$%&|<>]+"
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: One character for each word of the vocabulary.
CODES = "".join(chr(0x4E00 + k) for k in range(len(VOCABULARY)))


def _c(name: str) -> Column:
    return F.col(TMP + name)


def _reduced(docs: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """The columns to keep, the text (r0) and what is left of it after each class is taken out (r1, r2, ...)."""
    frame = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(f"{TMP}r0"))
    for k, pattern in enumerate(CLASSES):
        frame = frame.withColumn(f"{TMP}r{k + 1}", F.regexp_replace(_c(f"r{k}"), pattern, ""))
    return frame


def _class_counts() -> Column:
    size = [F.length(_c(f"r{k}")) for k in range(len(CLASSES) + 1)]
    return F.array(*(a - b for a, b in zip(size, size[1:], strict=False)), size[-1])


def _common() -> Column:
    """How many letter words r0 has (n), and the codes of those in the vocabulary."""
    code = lambda w: F.substring(F.lit(CODES), F.array_position(F.lit(VOCABULARY), w).cast("int"), F.lit(1))
    codes = lambda ws: F.array_join(F.transform(F.filter(ws, lambda w: w.isin(VOCABULARY)), code), "")
    found = F.array_remove(F.split(F.lower(_c("r0")), r"[^\p{L}]+"), "")
    return let(found, lambda ws: F.struct(F.size(ws).alias("n"), codes(ws).alias("codes")))


def _counts(codes: Column) -> Column:
    """How often each vocabulary word's code occurs."""
    return F.transform(F.lit(list(CODES)), lambda x: F.length(codes) - F.length(F.replace(codes, x, F.lit(""))))


def _measured(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns to keep, and what the rules count in the text."""
    frame = _reduced(docs, text, *keep).withColumn(f"{TMP}words", words(_c("r0")))
    lines = let(F.filter(F.split(_c("r0"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    chars, left = F.length(_c("r0")), F.length(_c("r1"))
    counted = {
        "n_words": F.size(_c("words")),
        "word_chars": chars - (left - F.length(F.regexp_replace(_c("r1"), SPACE, ""))),
        "n_symbols": left - F.length(F.regexp_replace(_c("r1"), SYMBOLS, "")),
        "n_dup_lines": lines,
        "n_repeat_words": repeated_words(_c("words")),
        "n_chars": chars,
    }
    return frame.select(*keep, *(x.cast("long").alias(TMP + k) for k, x in counted.items()), _class_counts().alias(f"{TMP}classes"), _common().alias(f"{TMP}common")).withColumn(f"{TMP}counts", _counts(_c("common")["codes"]))


#: Bits of a packed window that hold its place, so a text of more words takes the wide way.
PLACE = 20


def repeated_words(found: Column, size: int = 3, place: int = PLACE) -> Column:
    """How many words lie in a window of `size` words that the text has twice or more, by 64-bit hashes of the windows.

    Most texts repeat no window: their hashes are all distinct, and that ends it. Of the others, a window's place is packed with
    the upper bits of its hash into one long, as longs sort fast; equal upper bits of different hashes, or a text of over
    2 ** place words, take the wide way of sorting hashes and places as pairs. Both give the same number.
    """
    window = lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(size)))
    windows = F.transform(F.sequence(F.lit(0), F.size(found) - size), lambda i: window(i))
    low = F.lit((1 << place) - 1).cast("long")
    words_of = lambda starts: F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*(i + k for k in range(size)))))))

    def wide(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def of(s: Column) -> Column:
            again = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return words_of(F.array_compact(again))

        return let(F.sort_array(pairs), of)

    def packed(h: Column, n_distinct: Column) -> Column:
        upper = lambda x: F.shiftright(x, place)
        places = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

        def of(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (upper(x) == upper(F.get(s, k - 1))) | (upper(x) == upper(F.get(s, k + 1))))
            alike = F.size(F.array_distinct(F.transform(h, upper))) < n_distinct  # different hashes with one upper part
            return F.when(alike, wide(h)).otherwise(words_of(F.transform(again, lambda x: x.bitwiseAND(low))))

        return F.when(F.size(h) > (1 << place), wide(h)).otherwise(let(F.sort_array(places), of))

    def counted(h: Column) -> Column:
        return let(F.size(F.array_distinct(h)), lambda n: F.when(n == F.size(h), 0).otherwise(packed(h, n)))

    return F.when(F.size(found) > size, let(windows, counted)).otherwise(0)


REFERENCE = "array<struct<classes:array<double>,words:array<double>>>"


def _sums(m: DataFrame, lang: str) -> DataFrame:
    """For each language its shares of the character classes and of the common words (the last: all other words)."""
    n, k = len(VOCABULARY), len(CLASSES) + 1
    sums = [F.sum(F.get(_c("classes"), i)).alias(f"c{i}") for i in range(k)]
    sums += [F.sum(F.get(_c("counts"), i)).alias(f"w{i}") for i in range(n)]
    rows = m.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("lang")).agg(*sums, F.sum(_c("common")["n"]).alias("n"), F.sum(_c("n_chars")).alias("chars"))
    shares = [F.col(f"w{i}") / F.col("n") for i in range(n)]
    classes = F.array(*(F.col(f"c{i}") / F.col("chars") for i in range(k)))
    words_of = F.concat(F.array(*shares), F.array(F.greatest(F.lit(0.0), 1 - sum(shares, F.lit(0.0)))))
    return rows.where("chars > 0 and n > 0").select("lang", classes.alias("classes"), words_of.alias("words"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """For each language its shares of the character classes and of the common words (the last: all other words).

    Sums over all rows, weighted by their length, taken by partial sums on the executors. Rows without a language count as
    language "". Languages without a letter have no reference. This brings one row of some ninety numbers for each language
    to the driver; `judged` needs no driver for it.
    """
    rows = _sums(_measured(docs.withColumn(f"{TMP}lang", F.col(lang)), text, f"{TMP}lang"), f"{TMP}lang").collect()
    return {r["lang"]: (list(r["classes"]), list(r["words"])) for r in rows}


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence to base 2) of two arrays of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2)) + term(y, (x + y) / 2)).otherwise(y))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def _verdict(m: DataFrame, refs: Column, keep: tuple[str, ...], min_words: int, class_limit: float, word_limit: float, min_chars: int, min_known: int, symbol_limit: float | None) -> DataFrame:
    c = _c
    shares = lambda counts, n: F.transform(counts, lambda x: x / n)
    n = c("common")["n"]
    classes = F.when(c("n_chars") >= min_chars, shares(c("classes"), c("n_chars")))
    known = F.when(n >= min_known, shares(F.concat(c("counts"), F.array(n - F.aggregate(c("counts"), F.lit(0), lambda a, x: a + x))), n))
    m = m.withColumns({f"{TMP}p": classes, f"{TMP}q": known, f"{TMP}refs": refs})
    plain = F.lit(True) if symbol_limit is None else c("n_symbols") <= symbol_limit * c("n_words")
    failed = (c("n_words") < min_words) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    far = F.transform(c("refs"), lambda r: F.struct(F.coalesce(_distance(c("p"), r["classes"]), F.lit(0.0)).alias("c"), F.coalesce(_distance(c("q"), r["words"]), F.lit(0.0)).alias("w")))
    worst = F.transform(far, lambda x: F.struct(F.greatest(x["c"] / class_limit, x["w"] / word_limit).alias("worst"), x["c"].alias("c"), x["w"].alias("w")))
    m = m.withColumn(f"{TMP}best", F.array_min(worst))
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.select(
        *keep,
        *(c(x).alias(x) for x in out),
        failed.alias("base_failed"),
        (~failed & plain & F.coalesce(c("best")["worst"] <= 1, F.lit(True))).alias("kept"),
        c("best")["c"].alias("class_distance"),
        c("best")["w"].alias("word_distance"),
    )


LIMITS = {"min_words": 50, "class_limit": 0.27, "word_limit": 0.80, "min_chars": 200, "min_known": 100, "symbol_limit": None}


def apply_rules(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """The columns to keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    base_failed: fewer than min_words words, or over half of the words in repeated windows. kept: not base_failed,
    and for at least one reference both distances are within their limits; a distance counts only from min_chars
    characters or min_known letter words on. A symbol_limit is the most symbols a word that a kept document has. Without references every document that passes the base
    rules is kept. Null and empty texts have no words and fail; other columns than those to keep are ignored;
    every row is judged alone, so ids may be null or repeat. One pass, no shuffle, built-in functions only.
    """
    own = F.lit([]).cast(REFERENCE) if not refs else F.array(*(F.struct(F.lit(a).alias("classes"), F.lit(b).alias("words")) for a, b in refs.values()))
    return _verdict(_measured(docs, text, *keep), own, keep, **(LIMITS | limits))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """apply_rules with references from all of docs, whose texts are read and measured once.

    What is measured is checkpointed; each language's histogram, however many there are, is a partial sum on the executors, and all of them go
    to the rows as one value (a scalar subquery of some ninety numbers for each language).
    """
    m = cut(_measured(docs.withColumn(f"{TMP}lang", F.col(lang)), text, *keep, f"{TMP}lang"))
    refs = _sums(m, f"{TMP}lang").agg(F.sort_array(F.collect_list(F.struct("lang", "classes", "words"))).alias("r"))
    refs = refs.select(F.transform("r", lambda x: F.struct(x["classes"].alias("classes"), x["words"].alias("words"))).alias("r"))
    return _verdict(m, refs.scalar(), keep, **(LIMITS | limits))


def keep_clean(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep under references from all of docs."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = judged(docs.withColumn(f"{TMP}row", row), keep=(f"{TMP}row",), **limits)
    # not a filter: that would be pushed below the projections, with the whole of their expressions copied into it
    return rows.select(F.inline(F.when(F.col("kept"), F.array(f"{TMP}row"))))
