"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Every document is cut into whole windows of the longest context and a tail. Tails are routed to
tiers: the context sizes are the longest one, its half and its quarter, and a tail's tier is the smallest that holds it.
Tiers are packed from the longest down. A tier's window starts from its longest tail, the gap is filled with the largest
tails that fit, from the same or shorter tiers, and what no tail fits is filled by cutting one. When fewer
tokens are left than a window holds, they go to windows of still smaller powers of two, so no window is padded. A packer holds the tails of a bounded
number of tokens and hands the rest on, so memory does not follow the partition's size.
Sequences of one context size are dealt into step groups of equal count, in an order that balances
the attention cost (the sum of squared piece lengths) between groups.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from topiclog.llm.common import SLICE, Memo, slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " context long, step_group long"
)
NAMES = [x.split()[0] for x in SCHEMA.split(",")]
TYPES = pa.schema([(n, pa.int64()) for n in NAMES])
SPECIAL = "<|endoftext|>"
#: A word of Latin letters, perhaps with marks behind it: two pre-tokens at most.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)")
MARKS = ".,;:!?*#$%&|"
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
#: The character that byte-level vocabularies write for each byte: printable Latin-1 bytes as they are, the others from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}


class Recent(Memo):
    """A memo of two halves: a full half stays readable until the next one is full, so keys that come often are not computed again."""

    def __init__(self, fn: Callable, entries: int = 400_000):
        super().__init__(fn, entries // 2)
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's encode().

    A text is cut in front of each single space or line feed that stands between two other
    characters than white space: there every pre-token ends, so the parts can be encoded alone
    and remembered. Any other white space stays inside its part, and texts with the special token are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        split, merge = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model.tokenize
        coded = [i.to_bytes(4, "little") for i in range(1 + max(self.whole.get_vocab(with_added_tokens=True).values()))]
        pieces = Memo(lambda s: b"".join([coded[t.id] for t in merge(s)]))
        space = chr(BYTE_CHARS[0x20])

        def part(s: str) -> bytes:
            if plain := PLAIN.fullmatch(s):
                word, marks = plain.groups()
                word = pieces.fn(word.encode().decode("latin-1").translate(BYTE_CHARS))
                return word + pieces[marks] if marks else word
            return b"".join([pieces[p] for p, _ in split(s)])

        def behind_space(s: str) -> bytes:
            word = s.rstrip(MARKS)
            if word in known and LETTER.fullmatch(word[-1:]):  # marks behind a letter are a pre-token of their own
                return known[word] + pieces[s[len(word) :]]
            if s.isascii() and s.isalpha():
                return b"".join([coded[t.id] for t in merge(space + s)])
            return part(" " + s)

        self.bare = Recent(part)
        self.spaced = known = Recent(behind_space)
        self.feed = part("\n")

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        plain = text.replace(" ", "").replace("\n", "")
        if not plain or len(plain.split()) != 1 or plain[0].isspace() or plain[-1].isspace() or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return self.loose(text)
        spaced, bare, out = self.spaced.__getitem__, self.bare.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(bare(head))
            out.extend(map(spaced, rest))
            out.append(self.feed)
        out.pop()
        return b"".join(out)

    def loose(self, text: str) -> bytes:
        """Cuts only in front of a space that is followed by another character than white space."""
        if not text:
            return b""
        out, parts = [], []
        for k, word in enumerate(text.split(" ")):
            if k and word and not word[0].isspace():
                out.append(" ".join(parts))
                parts = ["", word]
            else:
                parts.append(word)
        out.append(" ".join(parts))
        return b"".join([self.bare[s] for s in out if s])


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class Packer:
    """Packs pieces (doc, start, ids as bytes, doc_tokens); `held` tokens of tails are kept at most."""

    def __init__(self, context: int, first_sequence: int, group: int, held: int):
        self.context, self.next, self.group, self.held = context, first_sequence, group, held
        self.tiers = sorted({max(1, context // 4), max(1, context // 2), context})
        self.tails: dict[int, list] = defaultdict(list)  # by length; all lengths of a tier lie together
        self.tokens = 0
        self.lengths = [0] * (context + 1)  # how many tails of each length wait
        self.ready: dict[int, list] = defaultdict(list)  # finished sequences by context size
        self.out: list[tuple] = []
        self.groups = 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n - n % self.context, self.context):
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.context)], n)])
        if n % self.context:
            self.hold((doc, n - n % self.context, ids[4 * (n - n % self.context) :], n))
        if self.tokens > self.held:
            self.pack(self.held // 2)

    def hold(self, piece) -> None:
        n = len(piece[2]) // 4
        self.tails[n].append(piece)
        self.lengths[n] += 1
        self.tokens += n

    def longest(self, most: int) -> int:
        """The largest length up to `most` of which a tail waits, else 0."""
        lengths = self.lengths
        while most and not lengths[most]:
            most -= 1
        return most

    def take(self, n: int):
        self.lengths[n] -= 1
        self.tokens -= n
        return self.tails[n].pop()

    def pack(self, leave: int) -> None:
        """Fills windows, each of the tier of the longest tail, while more than `leave` tokens wait."""
        while self.tokens > max(leave, self.context - 1):
            top = self.longest(self.context)
            pieces, room = [], next(c for c in self.tiers if c >= top)
            while room:
                if n := self.longest(room):
                    pieces.append(self.take(n))
                    room -= n
                    continue
                n = next(k for k in range(room + 1, self.context + 1) if self.lengths[k])
                doc, start, ids, total = self.take(n)  # the shortest that is too long is cut
                pieces.append((doc, start, ids[: 4 * room], total))
                self.hold((doc, start + room, ids[4 * room :], total))
                room = 0
            self.emit(pieces)

    def finish(self) -> None:
        self.pack(0)
        size = self.context // 2
        while self.tokens:
            while size > self.tokens:
                size //= 2
            pieces, room = [], size
            while room:
                n = self.longest(room) or next(k for k in range(room + 1, self.context + 1) if self.lengths[k])
                doc, start, ids, total = self.take(n)
                pieces.append((doc, start, ids[: 4 * room], total))
                if n > room:
                    self.hold((doc, start + room, ids[4 * room :], total))
                room -= min(n, room)
            self.emit(pieces)
        for size in sorted(self.ready):
            self.deal(size)

    def emit(self, pieces: list) -> None:
        size = sum(len(p[2]) for p in pieces) // 4
        self.ready[size].append([(doc, start, len(ids) // 4, zlib.crc32(ids), total) for doc, start, ids, total in pieces])
        if len(self.ready[size]) >= 16 * self.group:
            self.deal(size)

    def deal(self, size: int) -> None:
        """Ready sequences of a size go to step groups: by falling cost, there and back over the groups."""
        ready = sorted(self.ready.pop(size), key=lambda s: -sum(p[2] * p[2] for p in s))
        groups = -(-len(ready) // self.group)
        for k, pieces in enumerate(ready):
            turn, at = divmod(k, groups)
            group, offset = self.groups + (groups - 1 - at if turn % 2 else at), 0
            for doc, start, n, crc, total in pieces:
                self.out.append((doc, start, n, crc, total, self.next, offset, size, group))
                offset += n
            self.next += 1
        self.groups += groups


def pack(docs: DataFrame, tokenizer: Callable[[], str] | str, context: int = 1024, end_id: int = 0, group: int = 32, held: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group.

    A document's ids are the tokenizer's, then end_id. Each id lies in one piece. context (a power
    of two) is the longest window; a row's `context` is the size of its sequence, always the context or a
    smaller power of two, so no sequence is padded. step_group numbers the sequences that train together, within
    the tasks' share of a group id. A null or empty text is the end id alone; a null doc_id stays null; rows that
    repeat are packed each. Other columns are ignored. One pass over the input without a shuffle: each
    task packs its own rows, and ids carry the task's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = byte_bpe(tokenizer if isinstance(tokenizer, str) else tokenizer()).encode, end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        packer = Packer(context, base, group, held)
        packer.groups = base

        def rows():
            out, packer.out = packer.out, []
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 20_000], strict=True)], schema=TYPES)

        for batch in slices(batches, most=SLICE):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.add(doc, (encode(text) if text else b"") + end)
            yield from rows()
        packer.finish()
        yield from rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
