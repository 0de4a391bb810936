"""Near-duplicate documents by SimHash fingerprints that a binary trie joins with themselves.

The trie is spread over the cluster by the pigeonhole rule: of four blocks of a fingerprint's
bits, two fingerprints with at most three differing bits share one whole. So every distinct
fingerprint goes to four runs, one for each block, with that block's bits in front; a run is the subtree
under those bits. A task joins its subtrees with themselves: pairs of nodes go down together,
the differing bits add up, and a pair is dropped once they exceed the budget. Links are kept as a spanning
forest of each run, so a dense group gives fewer links than members. A run with more fingerprints
than a task should hold is cut again by the same rule on its other bits, in a further round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import SLICE, slices
from topiclog.llm.components import Forest, connected, cut, spread_join

BUDGET = 3
#: Bits of a block in each round, for BUDGET + 1 blocks that don't overlap: after the last, 21 bits are free, so no run can exceed 2 ** 21.
ROUNDS = (16, 12, 9, 6)
#: Fingerprints that a task joins at once, and the most of one run before it is cut again.
HELD, RUN = 1 << 18, 1 << 14


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bits set in over half the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    import xxhash

    found = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space alone
    if not found:
        return 0
    grams = map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False)) if len(found) >= size else [b" ".join(found)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            fp = np.array([fingerprint(x, size) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trie_join(keys: np.ndarray, starts: np.ndarray, depth: int, budget: int = BUDGET, leaf: int = 64, width: int = 1 << 18) -> np.ndarray:
    """For each key the index of the smallest key that it is linked with inside its run.

    keys: unsigned 64-bit, sorted inside runs; runs begin at `starts` and share their first `depth` bits.
    A frontier holds node pairs (two index ranges and their differing bits) of one level; pairs with at
    most `leaf` combinations are compared bit by bit, others split into their children's pairs.
    """
    forest, ones = Forest(len(keys)), {}
    ends = np.append(starts[1:], len(keys))
    many = ends - starts > 1
    stack = [(depth, starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64))]
    while stack:
        level, a, a2, b, b2, bits = stack.pop()
        if len(a) > width:
            stack += [(level, *(x[k : k + width] for x in (a, a2, b, b2, bits))) for k in range(0, len(a), width)]
            continue
        pairs = (a2 - a) * (b2 - b)
        small = (pairs <= leaf) | (level == 64)
        if small.any():
            compare(keys, forest, a[small], a2[small], b[small], b2[small], budget)
        a, a2, b, b2, bits = (x[~small] for x in (a, a2, b, b2, bits))
        if not len(a):
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        n = ones[level]
        am, bm, other = a2 - (n[a2] - n[a]), b2 - (n[b2] - n[b]), a != b
        found = [
            np.concatenate(x)
            for x in zip(
                (a, am, b, bm, bits),  # both children whose bit is 0
                (am, a2, bm, b2, bits),  # both whose bit is 1
                (a, am, bm, b2, bits + 1),
                (am[other], a2[other], b[other], bm[other], bits[other] + 1),  # of a node and itself, the same pair
                strict=True,
            )
        ]
        a, a2, b, b2, bits = found
        a, a2, b, b2 = a, a2, b, b2
        keep = (a2 > a) & (b2 > b) & (bits <= budget) & ~((a == b) & (a2 - a == 1))
        if keep.any():
            stack.append((level + 1, a[keep], a2[keep], b[keep], b2[keep], bits[keep]))
    return forest.root


def compare(keys: np.ndarray, forest: Forest, a, a2, b, b2, budget: int, at_once: int = 1 << 20) -> None:
    """Links the keys of each pair of ranges that differ in at most `budget` bits."""
    total = (a2 - a) * (b2 - b)
    cuts = np.searchsorted(np.cumsum(total), np.arange(at_once, total.sum() + at_once, at_once))
    for lo, hi in zip([0, *cuts + 1], [*cuts + 1, len(a)], strict=True):
        n, wide = total[lo:hi], (b2 - b)[lo:hi]
        if not len(n):
            continue
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[lo:hi][of] + k // wide[of], b[lo:hi][of] + k % wide[of]
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget) if len(i) else np.zeros(0, bool)
        forest.link(i[near], j[near])


def _join_runs(depth: int, last: bool):
    """Rows (perm, v, fp) of whole runs, sorted -> links (0, fp, root's fp) and rows of runs that are too large (1 + perm, v, fp)."""
    shift = np.uint64(64 - depth)

    def rows(kind, x, y):
        kind = pa.array(np.broadcast_to(kind, len(x)).astype(np.int32))
        return pa.RecordBatch.from_arrays([kind, pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["kind", "x", "y"])

    def solve(perm, v, fp):
        run = v >> shift
        starts = np.flatnonzero(np.concatenate([[True], (perm[1:] != perm[:-1]) | (run[1:] != run[:-1])]))
        sizes = np.diff(np.append(starts, len(v)))
        if not last and (large := sizes > RUN).any():
            out = np.repeat(large, sizes)
            yield rows(1 + perm[out], v[out], fp[out])
            perm, v, fp = perm[~out], v[~out], fp[~out]
            if not len(v):
                return
            starts = np.cumsum(sizes[~large]) - sizes[~large]
        root = trie_join(v, starts, depth)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield rows(0, fp[linked], fp[root[linked]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        over = None  # the run whose rows go straight to the next round
        for batch in batches:
            new = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *(batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2))]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            perm, v, fp = kept
            if over is not None:
                n = int(np.argmin(same)) if not (same := (perm == over[0]) & (v >> shift == over[1])).all() else len(v)
                if n:
                    yield rows(1 + perm[:n], v[:n], fp[:n])
                kept = [x[n:] for x in kept]
                if not len(kept[0]):
                    continue
                over, (perm, v, fp) = None, kept
            if len(v) >= HELD:
                same = (perm == perm[-1]) & (v >> shift == v[-1] >> shift)
                n = int(np.argmax(same))  # the last run may go on
                if n:
                    yield from solve(perm[:n], v[:n], fp[:n])
                if not last and len(v) - n > RUN:
                    over = (perm[-1], v[-1] >> shift)
                    yield rows(1 + perm[n:], v[n:], fp[n:])
                    n = len(v)
                kept = [x[n:] for x in kept]
        if len(kept[0]):
            yield from solve(*kept)

    return run


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints of the column fp that differ in at most BUDGET bits, directly or through others."""
    depth, rows, links = 0, distinct.selectExpr("0 perm", "fp v", "fp"), None
    for k, block in enumerate(ROUNDS):
        free = 64 - depth
        low = F.lit(-1 if free == 64 else (1 << free) - 1).cast("long")

        def turned(c: int, free=free, block=block, low=low):
            """v with the c-th block of its free bits in front of the others."""
            part = F.col("v").bitwiseAND(low)
            if not c:
                return part
            left = F.shiftleft(part, c * block).bitwiseAND(low)
            return left.bitwiseOR(F.shiftrightunsigned(part, free - c * block))

        ways = F.array(*(F.struct((F.col("perm") * (BUDGET + 1) + c).cast("int").alias("perm"), F.col("v").bitwiseAND(F.bitwise_not(low)).bitwiseOR(turned(c)).alias("v"), "fp") for c in range(BUDGET + 1)))
        depth += block
        runs = rows.select(F.inline(ways)).repartition("perm", F.shiftrightunsigned("v", 64 - depth)).sortWithinPartitions("perm", "v")
        last = k == len(ROUNDS) - 1
        found = cut(runs.mapInArrow(_join_runs(depth, last), "kind int, x long, y long"))
        new = found.where("kind = 0").selectExpr("x a", "y b")
        links = new if links is None else links.unionByName(new)
        rows = found.where("kind > 0").selectExpr("kind - 1 perm", "x v", "y fp")
        if last or rows.isEmpty():
            return links


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    Fingerprints over word shingles of `size` words link at BUDGET or fewer differing bits; component_id is
    the smallest doc_id reachable. Null and empty texts have fingerprint zero, linked like any other. A null doc_id
    stays null and never names a component unless all its rows have none. Rows with one doc_id are
    separate rows with a fingerprint each; ids are integers, or texts of integers. Other columns are ignored; an empty table gives no rows.
    Equal fingerprints become one before anything is joined, so groups of copies of any size cost one row.
    """
    prints = cut(fingerprints(docs, size))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = connected(near_links(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(member.join(lowest, "root").select("fp", "n", "component_id"))
    return spread_join(prints, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
