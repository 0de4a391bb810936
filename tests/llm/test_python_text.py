"""Classifier, token counts and packing: held-out accuracy, the libraries themselves, and an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from topiclog.llm import packing, quality_classifier, token_counts
from topiclog.llm.common import Memo, slices


def odd_strings(n, seed):
    rnd = random.Random(seed)
    chars = "ab e'\n .,1½é日🎉▁\t 　\r\x1c\x85\x0b\x00#*"
    return ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_token_counts_of_odd_strings(odd_rows):
    counter = token_counts.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.separable and counter.line_breaks and len(counter.spaced.fixed) > 5000
    for text in [*odd_strings(4000, 1), *(r[1] or "" for r in odd_rows), "<s> </s> <unk> <0x0A>"]:
        assert counter.count(text) == len(counter.model.encode(text)), repr(text[:60])


def test_token_counts(spark, clashing, odd_rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(map(str, map(tuple, token_counts.count_tokens(clashing, path, 100).collect())))
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for d, t, *_ in odd_rows]
    assert got == sorted(map(str, want))
    assert token_counts.count_tokens(clashing.limit(0), path).count() == 0


def test_byte_bpe_of_odd_strings(odd_rows):
    bpe = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*odd_strings(4000, 2), *(r[1] or "" for r in odd_rows), "a<|endoftext|> b", "don't we'll Ünï'S"]:
        want = np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert bpe.encode(text) == want, repr(text[:60])


def test_marks_behind_known_words():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["x foo) foo). foo 12 12. ... , x, foo, foo,, é é! foo.bar foo.bar. ' '. it's it's?", "x a) a). a a. x", *odd_strings(500, 3)]:
        assert bpe.encode(text) == np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_recent_computes_what_comes_often_once():
    calls = []
    memo = packing.Recent(lambda k: calls.append(k) or len(k), entries=4)
    for k in ("a", "bb", "a", "ccc", "a", "dddd", "a", "eeeee", "a"):
        assert memo[k] == len(k) and len(memo) + len(memo.before) <= 4
    assert calls == ["a", "bb", "ccc", "dddd", "eeeee"]


@pytest.mark.parametrize(("context", "held"), [(1024, 2_000_000), (64, 500), (8, 1)])
def test_packing_round_trip(spark, clashing, odd_rows, context, held):
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe = packing.byte_bpe(path)
    rows = packing.pack(clashing, path, context=context, held=held).collect()
    documents = defaultdict(list)  # by id and size, as ids may repeat
    for doc, text, *_ in odd_rows:
        ids = np.frombuffer(bpe.encode(text or "") + b"\0\0\0\0", "<u4")
        documents[doc, len(ids)].append(ids)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert pieces.keys() == documents.keys()
    for key, own in pieces.items():
        starts = sorted((r.start, r.length, r.ids_crc32) for r in own)
        want = []
        for ids in documents[key]:
            cuts = sorted({r.start for r in own} | {len(ids)}) if len(documents[key]) == 1 else None
            if cuts:
                want += [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
        if want:
            assert starts == want
        assert sum(r.length for r in own) == sum(map(len, documents[key]))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in own]
        assert [r.offset for r in own] == [0, *ends[:-1]]
        size = ends[-1]
        assert size <= context and size & (size - 1) == 0 and {r.context for r in own} == {size}
    assert packing.pack(clashing.limit(0), path).count() == 0


def test_step_groups_are_even():
    packer = packing.Packer(1024, 0, 8, 10_000)
    rnd = random.Random(3)
    for doc in range(3000):
        packer.add(doc, b"\1\0\0\0" * rnd.randint(1, 900))
    packer.finish()
    cost, members = defaultdict(int), defaultdict(set)
    for _, _, n, _, _, sequence, _, size, group in packer.out:
        if size == 1024:
            cost[group] += n * n
            members[group].add(sequence)
    sizes = sorted(map(len, members.values()))
    assert sizes[-1] <= 8
    full = [cost[g] for g, m in members.items() if len(m) == 8]
    assert len(full) > 50 and np.std(full) < 0.25 * np.mean(full)


def test_memo_forgets_but_keeps_what_is_fixed():
    memo = Memo(len, entries=3, fixed={"": 7})
    assert [memo[k] for k in ("", "a", "bb", "ccc", "dddd", "")] == [7, 1, 2, 3, 4, 7] and len(memo) <= 4


def test_slices_bound_their_text():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * (3 << 20), None, "y" * (6 << 20), "", "z" * (9 << 20), "w"]})
    parts = list(slices([batch]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [len(p) for p in parts] == [2, 2, 1, 1]


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    for r in docs.limit(40).collect():
        assert r.doc_id is not None
    want = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in range(1000)}
    got = out.collect()
    assert all(r.held_out == want[r.doc_id] and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 1000


def test_classifier_edges(spark, clashing):
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (1, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(clashing, labels).count() == clashing.count()
    assert quality_classifier.classify(clashing.limit(0), labels).count() == 0
    assert quality_classifier.classify(clashing, labels.limit(0)).where("score = 0.5").count() == clashing.count()


def test_flat_trees_equal_a_walk_node_by_node():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality_classifier.grow(x, y, trees=20)
    for row, p in zip(x[:50], t.predict(x[:50]), strict=True):
        total = t.base
        for k in t.roots:
            while not t.leaf[k]:
                k = t.left[k] + (row[t.feature[k]] > t.threshold[k])
            total += t.value[k]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((t.predict(x) > 0.5) == y).mean() > 0.95
