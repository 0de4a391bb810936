"""Line-level deduplication by overlapping windows of three lines.

A document's lines that are not blank give a window at each of them but the last two: three lines in a row, hashed
to 128 bits. A window that occurs more than once in the corpus is kept where it comes first (lowest doc_id,
then lowest line) and goes everywhere else: the lines that the other occurrences cover, overlaps merged, are
taken out of their texts. Only hashes and positions are shuffled to find them. Counts are taken before the shuffle, so a
window in a third of all documents is one row of each task; where its places are looked up again, they are dealt out by window and salt.
Texts move only if they lose lines: a bitmap over hashed keys tells each task which ones those can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import SPACE, TMP, let
from topiclog.llm.components import cut

KEY = [f"{TMP}id", f"{TMP}h"]
#: Into how many parts the places of one window are dealt.
SALTS = 16
#: Longs of the bitmap (64 keys each, 2 MB in all). More affected documents than bits only mean that more texts are shuffled.
BITMAP = 1 << 18


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its rows: doc_id (a null sorts first, as the least long) and a hash of the text."""
    least = F.lit(-(2**63)).cast("long")
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), least).alias(KEY[0]), F.xxhash64("text").alias(KEY[1]))


def windows(keyed: DataFrame, size: int = 3) -> DataFrame:
    """The key, the window's hash (w) and the lines that it covers (from, to)."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(F.regexp_replace(x, SPACE, " ")).alias("s"), i.alias("i")))
    full = F.filter(lines, lambda x: x["s"] != "")

    def of(ls):
        one = lambda k: F.struct(
            F.unhex(F.md5(F.concat_ws("\n", *(F.get(ls, k + j)["s"] for j in range(size))))).alias("w"),
            F.get(ls, k)["i"].alias("from"),
            F.get(ls, k + size - 1)["i"].alias("to"),
        )
        return F.when(F.size(ls) >= size, F.transform(F.sequence(F.lit(0), F.size(ls) - size), one))

    return keyed.select(*KEY, F.inline(let(full, of)))


def repeated(keyed: DataFrame, size: int = 3) -> DataFrame:
    """The key and the spans (from, to) of lines that later occurrences of windows cover."""
    every = cut(windows(keyed, size))
    place = F.struct(*KEY, "from")
    first = every.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    dealt = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = every.withColumn("salt", F.pmod(F.xxhash64(*KEY, "from"), F.lit(SALTS)).cast("int")).join(dealt, ["w", "salt"]).where(place != F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("from", "to")).alias(f"{TMP}spans"))


def _parted(keyed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed that can have spans, and those that have none for sure, by a bitmap of the spans' keys."""
    at = F.pmod(F.xxhash64(*KEY), F.lit(64 * BITMAP).cast("long"))
    place, mask = F.floor(at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    marks = spans.groupBy(place.alias("place")).agg(F.bit_or(mask).alias("mask"))
    dense = spans.sparkSession.range(0, BITMAP, 1, 1).select(F.col("id").cast("int").alias("place")).join(marks, "place", "left")
    bits = dense.agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("b")).select(F.col("b.mask"))
    marked = F.get(bits.scalar(), place).bitwiseAND(mask) != 0
    return keyed.where(marked), keyed.where(~marked)


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """All columns of docs, with the repeated lines taken out of text, and n_chars (if there is such a column) counted anew.

    Lines are compared without white space at their ends and with runs of white space as one space; blank lines take
    part in no window but go with the window around them. A null text stays null; a text of fewer
    lines than a window stays as it is. A document whose lines all lie in windows seen before is left with
    an empty text. Null doc_ids come before all others (ids are integers, or texts of integers); rows with one doc_id and one text are one document and
    get the same text. Columns of docs starting with "__tl_" are not supported; any other name is.
    """
    return marked(docs, size).drop(f"{TMP}n_lines", f"{TMP}n_removed")


def marked(docs: DataFrame, size: int = 3) -> DataFrame:
    """dedup_lines with __tl_n_lines and __tl_n_removed: the lines of each text before, and those taken out."""
    keyed = _keyed(docs)
    spans = F.coalesce(F.col(f"{TMP}spans"), F.array().cast("array<struct<from:int,to:int>>"))
    gone = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"]))))
    lines = F.split("text", "\n")
    found = cut(repeated(keyed, size))
    moved, still = _parted(keyed, found)
    joined = moved.join(found, KEY, "left").unionByName(still.withColumn(f"{TMP}spans", F.lit(None).cast(found.schema[f"{TMP}spans"].dataType)))
    joined = joined.withColumn(f"{TMP}gone", gone)
    kept = let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(f"{TMP}gone")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.size(f"{TMP}gone") > 0, kept).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*columns, n_lines.alias(f"{TMP}n_lines"), F.size(f"{TMP}gone").cast("long").alias(f"{TMP}n_removed"))


def dedup_report(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and text (without the repeated lines) of every row of docs."""
    return marked(docs.select("doc_id", "text"), size).select("doc_id", F.col(f"{TMP}n_lines").alias("n_lines"), F.col(f"{TMP}n_removed").alias("n_removed"), "text")
