"""Token counts of whole texts under a piece vocabulary, with most tokens counted by look-up.

A text is cut into pre-tokens in front of every space that follows another character. Where
no vocabulary string holds a space behind another character, no merge can cross such a cut, so
the counts of the pre-tokens add up to the count of the text. `Prover` checks that, and finds
offline which vocabulary strings encode alone as one token: those count one each, without the
encoder. All other pre-tokens are merged by the library, each once while it stays in a bounded
memo. A vocabulary that fails the proof is counted by encoding whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from topiclog.llm.common import SLICE, Memo, slices

SPACE_MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Prover:
    """What can be proven about a sentencepiece model without a text.

    separable: counts of pre-tokens add up. alone: words that, behind one space, are one token.
    line_breaks: a line feed never merges, so a line can be counted by itself.
    """

    def __init__(self, model):
        normal, strings = [], []
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                normal.append(i)
                strings.append(model.id_to_piece(i))
        probe = ["a  b", " a", "a ", "  ", "Åﬁ①", "a\tb c"]
        unchanged = all(model.normalize(x) == SPACE_MARK + x.replace(" ", SPACE_MARK) for x in probe)
        self.separable = unchanged and not any(SPACE_MARK in s.lstrip(SPACE_MARK) for s in strings)
        self.line_breaks = not any("\n" in s for s in strings)
        words = [s[1:] for s in strings if s[0] == SPACE_MARK and len(s) > 1 and s[1] != SPACE_MARK]
        self.alone = {w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1}


class Counter:
    """Counts tokens of texts exactly as the model's encode() does."""

    def __init__(self, model):
        self.model, proof = model, Prover(model)
        self.separable, self.line_breaks = proof.separable, proof.line_breaks
        encode = model.encode
        mark = len(encode("a ")) - len(encode("a"))  # a space with nothing behind it
        broken = len(encode("\n"))
        self.feed = broken - mark
        self.spaced = Memo(lambda w: len(encode(w)), longest=64, fixed=dict.fromkeys(proof.alone, 1) | {"": mark})
        self.bare = Memo(lambda w: len(encode("\n" + w)) - broken, longest=64, fixed={"": 0})

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text))
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, " ")
        if text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or not self.line_breaks:
            return sum(map(self.spaced.__getitem__, (w[1:] for w in re.findall(" *[^ ]+| +$", " " + text))))
        first, *lines = text.split("\n")
        spaced = self.spaced.__getitem__
        total = sum(map(spaced, first.split(" "))) + self.feed * len(lines)
        for line in lines:
            head, *rest = line.split(" ")
            total += self.bare[head] + sum(map(spaced, rest))
        return total


@cache
def piece_counter(path: str) -> Counter:
    import sentencepiece

    return Counter(sentencepiece.SentencePieceProcessor(model_file=path))


def count_tokens(docs: DataFrame, model: Callable[[], str] | str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs.

    model: the vocabulary file's path on the executors, or a function that gives it there.
    A null or empty text has no bytes and no tokens; a null doc_id stays null; rows that repeat
    are counted each; other columns are ignored. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model if isinstance(model, str) else model()).count
        for batch in slices(batches, most=SLICE):
            text = batch.column("text")
            n = pa.array([count(x) if x else 0 for x in text.to_pylist()], pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
