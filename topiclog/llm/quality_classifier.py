"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of labelled rows (the lowest hashes of their ids), so what the driver holds has a
fixed size: `sample` rows of numbers. Features are cut into quantile bins, trees grow level by level
from gradient histograms, and the finished ensemble is flattened into arrays that numpy walks for all
rows and trees at once. Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import SLICE, slices

#: Class of each byte of UTF-8: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence marks, 5 symbols, 6 control, 7 beyond ASCII.
BYTE_CLASS = np.full(256, 7)
BYTE_CLASS[:128] = 6
for _class, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\f\r", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    BYTE_CLASS[list(_bytes)] = _class
NAMES = [
    *("bytes", "words", "lines", "lower", "upper", "digits", "space", "marks", "symbols", "control", "beyond_ascii"),
    *("mean_word", "sd_word", "distinct_words", "top_word", "word_entropy", "repeated_threes", "equal_neighbours", "repeated_lines"),
    *("mean_line", "short_lines", "pipes", "exclamations", "stops", "byte_entropy", "open_words", "capital_words", "top_line"),
]


def statistics(text: str | None) -> list[float]:
    """NAMES of a whole text; an empty one has zeros only."""
    data = (text or "").encode()
    found = data.split()
    if not found:
        return [float(len(data)), *[0.0] * (len(NAMES) - 1)]
    n, count = len(data), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(BYTE_CLASS, weights=count, minlength=8)
    sizes = np.fromiter(map(len, found), np.float64, len(found))
    words = Counter(found)
    tally = np.fromiter(words.values(), np.float64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_tally = Counter(lines)
    threes = Counter(zip(found, found[1:], found[2:], strict=False))
    starts = sum(1 for w in found if 65 <= w[0] <= 90)
    p, q = tally / len(found), count[count > 0] / n
    return [
        np.log1p(n),
        np.log1p(len(found)),
        np.log1p(len(lines)),
        *(classes / n),
        sizes.mean(),
        sizes.std(),
        len(words) / len(found),
        tally.max() / len(found),
        -(p * np.log2(p)).sum(),
        sum(k for k in threes.values() if k > 1) / len(found),
        sum(map(bytes.__eq__, found, found[1:])) / len(found),
        1 - len(line_tally) / len(lines),
        n / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        count[124] / len(found),
        count[33] / len(found),
        count[46] / len(found),
        -(q * np.log2(q)).sum(),
        sum(1 for w in found if w[-1] not in b".,;:!?") / len(found),
        starts / len(found),
        max(line_tally.values()) / len(lines),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float32).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """An ensemble in arrays: node k of a tree goes to left[k] where x[feature[k]] <= threshold[k], else to left[k] + 1; leaves go to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        if len(self.roots):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(self.leaf[at], at, self.left[at] + right)
            total += self.value[at].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 20.0, l2: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; without both labels the ensemble is a constant."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.int64)
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(empty, empty, empty.astype(np.float32), empty, empty.astype(bool), empty.astype(float), 0, base)
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) + np.arange(k) * bins
    nodes: list[list] = []  # feature, threshold, left child, is a leaf, value
    roots, raw = [], np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, True, 0.0])
        place = np.full(n, roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            local = np.full(len(nodes), -1)
            local[level] = np.arange(len(level))
            slot = local[place]
            live = np.flatnonzero(slot >= 0)
            size = len(level) * k * bins
            at = (slot[live, None] * k * bins + coded[live]).ravel()
            sums = [np.bincount(at, np.repeat(v[live], k), size).reshape(len(level), k, bins) for v in (g, h)]
            totals = [np.bincount(slot[live], v[live], len(level)) for v in (g, h)]
            for i, node in enumerate(level):
                nodes[node][4] = -rate * totals[0][i] / (totals[1][i] + l2)
            if d == depth:
                break
            gl, hl = (s.cumsum(2) for s in sums)
            gr, hr = totals[0][:, None, None] - gl, totals[1][:, None, None] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (totals[0] ** 2 / (totals[1] + l2))[:, None, None]
            counts = np.bincount(at, minlength=size).reshape(len(level), k, bins).cumsum(2)
            own = np.bincount(slot[live], minlength=len(level))[:, None, None]
            allowed = (counts >= least) & (own - counts >= least)
            for j, c in enumerate(cuts):
                allowed[:, j, len(c) :] = False
            gain = np.where(allowed, gain, -np.inf).reshape(len(level), -1)
            best, following = gain.argmax(1), []
            for i, node in enumerate(level):
                if gain[i, best[i]] <= 1e-6:
                    continue
                feature, cut = divmod(int(best[i]), bins)
                nodes[node][:4] = [feature, float(cuts[feature][cut]), len(nodes), False]
                inside = place == node
                place[inside] = len(nodes) + (coded[inside, feature] - feature * bins > cut)
                following += [len(nodes), len(nodes) + 1]
                nodes += [[0, 0.0, 0, True, 0.0], [0, 0.0, 0, True, 0.0]]
            if not (level := following):
                break
        value = np.array([v[4] for v in nodes])
        raw += value[place]
    feature, threshold, left, leaf, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), feature, threshold.astype(np.float32), left, leaf, value, depth, base)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and y of at most `sample` documents with a label, by the lowest hashes of their ids; a document of several labels has their rounded mean.

    Where several rows have one id, the text with the lowest hash stands for it.
    """
    mean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = mean.select(F.col("doc_id").alias("__tl_id"), (F.col("y") >= 0.5).cast("int").alias("__tl_y"))
    chosen = known.orderBy(F.xxhash64("__tl_id"), "__tl_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__tl_id")).groupBy("__tl_id", "__tl_y")
    return rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", F.col("__tl_y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> Trees:
    """Trees from labels (doc_id, quality) of docs (doc_id, text).

    sample bounds the labelled ids that are broadcast and the rows of statistics that the driver gets (28 numbers
    each). Labels of unknown documents, null labels and null ids are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            x = matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column("y")], names=["x", "y"])

    rows = labelled(docs, labels, sample).mapInArrow(run, "x array<float>, y int").collect()  # one for each id: `sample` at most
    x = np.array([r.x for r in rows], np.float32).reshape(-1, len(NAMES))
    y = np.array([r.y for r in rows], float)
    order = np.lexsort(np.column_stack([y, x]).T)  # the rows' order of arrival must not matter
    return grow(x[order], y[order], **options)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from score 0.5 on) of every row.

    The score depends on the whole text alone. Null counts as empty; empty texts have a score too; a null doc_id stays
    null (ids are integers, or texts of integers) and rows that repeat are scored each. Other columns are ignored. One pass, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            x = matrix(batch.column("text").to_pylist())
            p = np.concatenate([model.value.predict(x[k : k + 1024]) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1 (no for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; trained on labels of documents that aren't held out."""
    trees = train(docs, labels.where(~held_out()), sample)
    return score(docs, trees).select("doc_id", held_out().alias("held_out"), "score", "predicted")
