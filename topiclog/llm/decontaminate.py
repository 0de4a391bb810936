"""Benchmark decontamination by word windows, in built-in functions only.

The windows of the test items are a hash set that every task holds (a broadcast, behind a check of its
measured size; beyond that the hashes are joined by a shuffle). A document is cut into blocks of words that
overlap by a window, so a very long text never becomes one huge array of windows. Each window is probed by its 64-bit hash; the few places
that hit go back to their texts, where the words themselves are compared, so every hit is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import TMP, let, lower_ascii
from topiclog.llm.components import cut

#: Everything that is no word character: ASCII without digits and letters (words are then lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a document that are turned into windows at once.
BLOCK = 4096
#: Most bytes of the windows' hashes that are broadcast, and of the places that go back to their texts.
BROADCAST = 64 << 20


def item_words(text: Column) -> Column:
    """Words with A-Z lower-cased; null has none."""
    found = F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(lower_ascii(w)))


def _hashes(ws: Column, count: Column, size: int) -> Column:
    """The hashes of `count` windows of `size` words from the first word on, each made of the hashes of its pairs of words; null where count is not positive."""
    at = F.sequence(F.lit(0), count - 1)
    if size < 4:
        return F.when(count > 0, F.transform(at, lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(size)))))
    places = sorted({*range(0, size - 1, 2), size - 2})
    pairs = F.transform(F.sequence(F.lit(0), count + size - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))
    return F.when(count > 0, let(pairs, lambda p: F.transform(at, lambda i: F.xxhash64(*(F.get(p, i + j) for j in places)))))


def item_windows(items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """w (a window's words) with its number of words and hash, each once; and w with each item that has it. An item with fewer words is one window."""
    own = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(size)).cast("int")
    at = F.sequence(F.lit(0), F.size("ws") - n)

    def of(k: int) -> Column:
        whole = F.transform(at, lambda i: F.array_join(F.slice("ws", i + 1, k), " "))
        return F.zip_with(whole, _hashes(F.col("ws"), F.size("ws") - k + 1, k), lambda w, h: F.struct(w.alias("w"), h.alias("h")))

    rows = cut(own.select("item", n.alias("size"), F.inline(F.coalesce(*(F.when(n == k, of(k)) for k in range(size, 0, -1))))).distinct())
    return rows.select("w", "size", "h").distinct(), rows.where("item is not null").select("w", "size", "item").distinct()


def places(docs: DataFrame, windows: DataFrame, key: list[str], size: int = 10, text: str = "text") -> DataFrame:
    """key and found (pos, size and the item's words w, of every window of a text whose hash is that of an item's) of the texts that have any."""
    bound = windows.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    sizes = bound["sizes"] or [size]  # `size` values at most
    hashes = windows.select(F.col("size").alias(f"{TMP}size"), F.col("h").alias(f"{TMP}w")).distinct()
    if 48 * bound["n"] <= BROADCAST:
        hashes = F.broadcast(hashes)
    own = docs.select(*key, item_words(F.col(text)).alias(f"{TMP}ws"))
    n = F.size(f"{TMP}ws")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK)))
    block = F.transform(starts, lambda s: F.struct(s.alias("from"), F.slice(F.col(f"{TMP}ws"), s + 1, BLOCK + size - 1).alias("ws")))
    blocks = own.select(*key, F.inline(block)).withColumnRenamed("from", f"{TMP}from").withColumnRenamed("ws", f"{TMP}ws")

    def of(k: int) -> Column:
        count = F.least(F.lit(BLOCK), F.size(f"{TMP}ws") - k + 1)
        return F.struct(F.lit(k).alias(f"{TMP}size"), _hashes(F.col(f"{TMP}ws"), count, k).alias(f"{TMP}hs"))

    each = blocks.select(*key, f"{TMP}from", F.inline(F.array(*map(of, sizes))))
    probed = each.select(*key, f"{TMP}from", f"{TMP}size", F.posexplode(f"{TMP}hs").alias(f"{TMP}at", f"{TMP}w")).join(hashes, [f"{TMP}w", f"{TMP}size"])
    near = cut(probed.select(*key, (F.col(f"{TMP}from") + F.col(f"{TMP}at")).alias("pos"), F.col(f"{TMP}size").alias("size"), F.col(f"{TMP}w").alias("h")).distinct())
    return cut(near.join(windows, ["size", "h"]).groupBy(*key).agg(F.collect_list(F.struct("pos", "size", "w")).alias(f"{TMP}found")))


def verified(docs: DataFrame, near: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """docs with __tl_n (words of the text) and __tl_hit (pos, size, w of every window that is an item's, word for word, by pos)."""
    found = F.col(f"{TMP}found")
    size = near.agg(F.sum(F.aggregate(f"{TMP}found", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["w"]) + 48))).first()[0] or 0
    # the other join deals all texts out by their key; it is taken when the places do not fit into every task
    joined = docs.join(F.broadcast(near) if size <= BROADCAST else near, key, "left")
    true = lambda ws: F.sort_array(F.filter(found, lambda x: F.array_join(F.slice(ws, x["pos"] + 1, x["size"]), " ") == x["w"]))
    both = let(item_words(F.col(text)), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.when(found.isNotNull(), true(ws)).alias("hit")))
    whole = joined.withColumn(f"{TMP}b", both)
    return whole.select(*docs.columns, F.col(f"{TMP}b")["n"].alias(f"{TMP}n"), F.col(f"{TMP}b")["hit"].alias(f"{TMP}hit"))


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    key = [f"{TMP}id", f"{TMP}h"]
    return docs.select("*", F.xxhash64(F.col("doc_id").cast("string"), text).alias(key[0]), F.xxhash64(text).alias(key[1])), key


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    n_hit counts the words inside any occurrence of an item's window, n_items the items with an occurring window;
    items_sha256 is over their ids, sorted as strings and comma-joined. A null or empty text has no words and no
    hits, an item without words has no windows, an item without an id hits but is not listed, rows of the
    benchmark that repeat count once. Rows that repeat in docs get the same result each; a null doc_id stays
    null, and ids may be of any type. Other columns are ignored. Texts are read twice; only hits and three numbers of each document are shuffled.
    """
    windows, owners = item_windows(items, size)
    keyed, key = _keyed(docs.select("doc_id", F.col(text).alias(f"{TMP}text")), f"{TMP}text")
    own = verified(keyed, places(keyed, windows, key, size, f"{TMP}text"), key, f"{TMP}text")
    end = lambda a, x: F.greatest(a["end"], x["pos"] + x["size"])
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate(f"{TMP}hit", zero, lambda a, x: F.struct(end(a, x).alias("end"), (a["n"] + F.greatest(F.lit(0), x["pos"] + x["size"] - F.greatest(a["end"], x["pos"]))).alias("n")), lambda a: a["n"])
    rows = cut(own.select("doc_id", *key, F.col(f"{TMP}n").alias("n_words"), F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.array_distinct(F.transform(f"{TMP}hit", lambda x: F.struct(x["w"].alias("w"), x["size"].alias("size")))).alias(f"{TMP}ws")))
    hit = rows.where("n_hit > 0").select(*key, F.inline(f"{TMP}ws")).distinct()
    found = hit.join(owners, ["w", "size"]).groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.select(*key, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.join(found, key, "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of an item occurs.

    Documents are removed whole, as what is around a test passage often gives it away. Rows whose doc_id is
    null are judged by their text like any other, rows that repeat each; null and empty texts stay.
    """
    windows, _ = item_windows(items, size)
    keyed, key = _keyed(docs, "text")
    own = verified(keyed, places(keyed, windows, key, size), key)
    row = F.array(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    # not a filter: that would be pushed below the projection, with the texts split once more for it
    return own.select(F.inline(F.when(F.coalesce(F.size(f"{TMP}hit"), F.lit(0)) <= 0, row)))
