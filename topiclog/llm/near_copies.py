"""Documents whose sets of word shingles have a Jaccard similarity of SIMILAR or more, exactly: SimHash proposes, an exact check decides, a prefix filter finds the rest.

The first candidates come from operator 2: fingerprints over the same shingles, which its trie joins with itself. Its three bits stand for a
similarity of about 0.98, so most pairs of SIMILAR lie beyond them. Those come from the prefix filter: in one order of all shingles, two sets that
are similar enough share a shingle among the first n - ceil(SIMILAR * n) + 1 of each. Any order will do, so shingles are in the order of
their hashes, and those that a sample finds frequent come last: that makes groups small and decides nothing. Each
candidate pair is held against bitmaps of the sets, as long as the sets, which bound what they can share, and if that leaves it possible
against the whole sets, made anew from the texts. First each set is compared with its group's first by SimHash; then, where a shingle's sets are not all connected,
with the neighbour by size that it shares most with, and with a hub: the set of most shingles that others have too, which a copy of few changes is. Then all
pairs that are not connected yet are compared, so a large group of near copies costs about as many pairs as it has members; copies with too many changes
to be linked at all are the exception: that no pair of them is similar is only known when each was looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiclog.llm.common import SLICE, slices
from topiclog.llm.components import connected, cut, spread_join
from topiclog.llm.simhash import fingerprint, near_links

#: Words of a shingle, and the least similarity as a fraction.
SIZE, SIMILAR = 5, (4, 5)
#: Least bits of a set's bitmap; a larger set has a power of two not below its size. Each shingle turns one over, so two bitmaps differ in no more bits than the sets in shingles.
BITS = 1024
#: Numbers of the fold of a bitmap that goes with every shingle where pairs are listed.
FOLD = 4
#: Most hashes of wanted texts, or keys of rows, that are broadcast (8 and 25 bytes each); beyond that the same join is a shuffle.
BROADCAST = 1 << 21


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space alone
    if not found:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False)) if len(found) >= size else [b" ".join(found)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64))


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set by which candidates find it: the first of the order in which `frequent` (sorted) come last."""
    most, of = SIMILAR
    n = len(own) - -(-most * len(own) // of) + 1 if len(own) else 0
    if len(frequent) and len(own):
        last = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~last], own[last]])
    return own[:n]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _node(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes())


def bitmap(own: np.ndarray) -> np.ndarray:
    """Bits in 64-bit numbers; a bit says whether an odd number of shingles fall on it."""
    bits = max(BITS, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: Column, size: Column) -> Column:
    """The bitmap that the set would have with `size` numbers, which divide its own."""
    fold = lambda i: F.aggregate(F.sequence(F.lit(0), (F.size(bits) / size).cast("int") - 1), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(bits, i + k * size)))
    return F.when(F.size(bits) == size, bits).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda i: fold(i)))


def frequent_shingles(docs: DataFrame, one_in: int = 16, least: int = 8, most: int = 1 << 16) -> np.ndarray:
    """Shingles of at least `least` of the texts in a sample, the `most` most frequent; they are for the order alone, no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            own = [shingles(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["g"]) if own else pa.RecordBatch.from_pydict({"g": pa.array([], pa.int64())})

    some = docs.select("text").where(f"pmod(xxhash64(text), {one_in}) = 0").distinct()
    rows = some.mapInArrow(run, "g long").groupBy("g").count().where(F.col("count") >= least).orderBy(F.desc("count"), "g").limit(most).collect()
    return np.sort(np.array([r.g for r in rows], np.int64).view(np.uint64))


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of the set), fp (fingerprint), n, common (how many of the set are frequent), bits and prefix of every row."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = batch.column("text").to_pylist()
            own = [shingles(x) for x in texts]
            node = np.array([_node(x) for x in own], np.uint64).view(np.int64)
            fp = np.array([fingerprint(x, SIZE) for x in texts], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(node), pa.array(fp), pa.array([len(x) for x in own], pa.int32()), pa.array([int(np.isin(x, frequent.value, assume_unique=True).sum()) for x in own], pa.int32()), _lists([bitmap(x) for x in own]), _lists([prefix(x, frequent.value) for x in own])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "fp", "n", "common", "bits", "prefix"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) h", "text").mapInArrow(run, "doc_id long, h long, node long, fp long, n int, common int, bits array<long>, prefix array<long>")


def _sizes_fit(a: str, b: str) -> Column:
    most, of = SIMILAR
    return of * F.least(a, b) >= most * F.greatest(a, b)


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; nodes: node, n, h and bits."""
    most, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, seen = [], {}
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), batch.column(3), strict=True):
                if len(seen) > 64:
                    seen.clear()
                for node, text in ((a, x), (b, y)):
                    if node not in seen:
                        seen[node] = shingles(text.as_py())
                both = len(np.intersect1d(seen[a], seen[b], assume_unique=True))
                near.append((most + of) * both >= most * (len(seen[a]) + len(seen[b])))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda name: nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "h", "bits")))
    least = F.least(F.size("a_bits"), F.size("b_bits"))
    apart = F.aggregate(F.zip_with(_folded(F.col("a_bits"), least), _folded(F.col("b_bits"), least), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("a_n") + F.col("b_n")
    possible = cut(pairs.join(side("a"), "a").join(side("b"), "b").where((most + of) * (total - apart) >= 2 * most * total).select("a", "b", "a_h", "b_h"))
    wanted = possible.select(F.explode(F.array("a_h", "b_h")).alias("h")).distinct()
    if 2 * possible.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.selectExpr("xxhash64(text) h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    whole = possible.join(texts.select(F.col("h").alias("a_h"), F.col("text").alias("x")), "a_h").join(texts.select(F.col("h").alias("b_h"), F.col("text").alias("y")), "b_h")
    return whole.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the first node of its group by SimHash, where their sizes allow for it."""
    roots = connected(near_links(distinct.select("fp").distinct()))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("root"))
    first = member.groupBy("root").agg(F.min(F.struct("node", "n")).alias("first"))
    pairs = member.join(first, "root").select("node", "n", F.col("first.node").alias("a"), F.col("first.n").alias("a_n"))
    return pairs.where(F.col("node") != F.col("a")).where(_sizes_fit("n", "a_n")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, h and node of every row, and node with its component's root."""
    prints = cut(_prints(docs))
    distinct = cut(prints.groupBy("node").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("common").alias("common"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")))
    alike = cut(_alike(distinct))
    first_links = cut(similar(alike, distinct, docs))
    roots = connected(first_links)
    # a shingle whose sets are all connected has nothing more to find; the others' sets meet their neighbours by size
    order, whole = Window.partitionBy("g").orderBy("n", "node"), Window.partitionBy("g")
    around = {"prev": F.lag("node").over(order), "prev_n": F.lag("n").over(order), "prev_part": F.lag("part").over(order), "low": F.min("part").over(whole), "high": F.max("part").over(whole), "hub": F.max(F.struct("common", "node", "n", "part")).over(whole)}
    rows = distinct.select("node", "n", "common", "prefix").join(roots, "node", "left").select("node", "n", "common", F.coalesce("root", "node").alias("part"), F.explode("prefix").alias("g"))
    groups = cut(rows.withColumns(around).where("low <> high").drop("low", "high"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # a copy with few changes has many shingles that others have too: it is the likeliest to be near to the rest of its group
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("prev").alias("to"), F.col("prev_n").alias("to_n"), F.col("prev_part").alias("to_part")), F.struct(F.lit(1).alias("way"), F.col("hub.node").alias("to"), F.col("hub.n").alias("to_n"), F.col("hub.part").alias("to_part")))
    shared = groups.select("node", "n", "part", F.inline(ways)).where((F.col("to_part") != F.col("part")) & _sizes_fit("to_n", "n")).groupBy("node", "way", "to").count()
    near = shared.groupBy("node", "way").agg(F.max_by("to", F.struct("count", "to")).alias("to")).select(*pair("to", "node"))
    beside = cut(near.distinct().join(alike, ["a", "b"], "left_anti"))
    links = first_links.unionByName(cut(similar(beside, distinct, docs)))
    roots = connected(links)
    beside = beside.unionByName(alike)
    # what is not connected yet: in each group all pairs of different components, none of which lies in the largest whole
    placed = groups.select("g", "node", "n").join(roots, "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("part"))
    size = placed.groupBy("g").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("g")
    # a fold of the bitmaps that is small enough to ride along with each shingle already rules most pairs out
    names = [f"s{k}" for k in range(FOLD)]
    small = distinct.select("node", _folded(F.col("bits"), F.lit(FOLD)).alias("s")).select("node", *(F.get("s", F.lit(k)).alias(c) for k, c in enumerate(names)))
    placed = cut(placed.join(size, "g").join(small, "node"))
    main = placed.groupBy("g", "part").count().groupBy("g").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    outside = placed.join(main, "g").where("part <> main").select("g", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("part").alias("other_part"), "main", *(F.col(c).alias(f"other_{c}") for c in names))
    most, of = SIMILAR
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in names), F.lit(0))
    total = F.col("n") + F.col("other_n")
    across = (F.col("part") != F.col("other_part")) & ((F.col("part") == F.col("main")) | (F.col("node") < F.col("other"))) & _sizes_fit("n", "other_n") & ((most + of) * (total - differ) >= 2 * most * total)
    rest = outside.join(placed, "g").where(across).select(*pair("node", "other")).distinct().join(beside, ["a", "b"], "left_anti")
    more = cut(similar(rest, distinct, docs))
    if not more.isEmpty():
        roots = connected(links.unionByName(more))
    return prints.select("doc_id", "h", "node"), distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of every row of docs.

    Rows whose sets of shingles of SIZE words have a Jaccard similarity of SIMILAR or more are linked; component_id is the smallest
    doc_id reachable. Texts without words are alike. A null doc_id stays null and names a component only if all its rows have
    none. Equal sets become one before anything is compared. Rows with one doc_id are rows of their own; an empty table gives no rows.
    """
    prints, member = _components(docs)
    # rows of a set, then of a component, are combined before they are dealt out, so one of any size is a row of each task
    own = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(member, "node")
    lowest = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(own.join(lowest, "root").select("node", "n", "component_id"))
    return spread_join(prints, named, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id (null last), then of the least hash of its text.

    A row is known by its doc_id and its text, so different texts under one doc_id, or under none, stay unless they are near copies; of rows that agree in
    both, one stays (that of the least hash of all columns). Null and empty texts, and those of white space alone, are one group.
    """
    prints, member = _components(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    rows = prints.groupBy("doc_id", "h", "node").agg(F.count("*").alias("n"))
    own = rows.groupBy("node").agg(F.min(rank).alias("f"), F.count("*").alias("n")).join(member, "node")
    first = own.groupBy("root").agg(F.min("f").alias("first"))
    named = cut(own.join(first, "root").select("node", "n", F.col("first").alias("f")))
    stays = (F.struct(*rank_of("f")) == F.struct(*rank_of(None))).alias("__tl_stays")
    odd = spread_join(rows.withColumnRenamed("n", "times"), named, "node").withColumnRenamed("times", "n").select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("__tl_id"), F.col("doc_id").isNull().alias("__tl_none"), F.col("h").alias("__tl_h"), "n", stays)
    # most rows stay and are alone: only those that go, or of which one of several stays, need be known
    odd = cut(odd.where("not __tl_stays or n > 1").drop("n"))
    key = ["__tl_id", "__tl_none", "__tl_h"]
    of = {"__tl_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "__tl_none": F.col("doc_id").isNull(), "__tl_h": F.xxhash64("text")}
    marked = docs.withColumns(of).join(F.broadcast(odd) if odd.count() <= BROADCAST else odd, key, "left")
    names = [f"`{c}`" for c in docs.columns]
    plain = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(*key).orderBy(F.xxhash64(*plain))
    again = marked.where("__tl_stays").withColumn("__tl_n", F.row_number().over(order)).where("__tl_n = 1")
    return marked.where("__tl_stays is null").select(*names).unionByName(again.select(*names))


def rank_of(struct: str | None) -> list[Column]:
    """A row's rank with nulls made comparable."""
    own = (lambda c: F.col(f"{struct}.{c}")) if struct else F.col
    return [F.coalesce(own("doc_id"), F.lit(0).cast("long")).alias("id"), own("doc_id").isNull().alias("none"), own("h").alias("h")]
