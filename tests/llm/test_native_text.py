"""Quality rules, decontamination and line deduplication against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from topiclog.llm import decontaminate, line_dedup, quality_rules

SPACE = re.compile("[\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)

    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def histograms(text):
    import regex

    left, counts = text, []
    for c in [r"\p{Ll}+", r"[\x20\x09-\x0d]+", r"\p{Lu}+", r"\p{N}+", r"[.,;:!?'\"()-]+", r"[\p{L}\p{M}]+"]:
        less = regex.sub(c, "", left)
        counts.append(len(left) - len(less))
        left = less
    words = Counter(w for w in regex.split(r"[^\p{L}]+", text.lower()) if w)
    n = sum(words.values())
    common = [words[w] for w in quality_rules.VOCABULARY]
    return [*counts, len(left)], [*common, n - sum(common)], n


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_quality_rules(spark, odd_docs, sample, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sample}/documents.parquet")
    refs = quality_rules.references(docs)
    texts = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    sums = defaultdict(lambda: [0, 0, 0])
    for _, text, lang in texts:
        a, b, _ = histograms(text)
        old = sums[lang]
        sums[lang] = [[x + y for x, y in zip(old[0] or [0] * len(a), a, strict=True)], [x + y for x, y in zip(old[1] or [0] * len(b), b, strict=True)], 0]
    for lang, (a, b) in refs.items():
        assert a == pytest.approx([x / sum(sums[lang][0]) for x in sums[lang][0]])
        assert b == pytest.approx([x / sum(sums[lang][1]) for x in sums[lang][1]], abs=1e-12)
    got = sorted((str(r.doc_id), *r[1:6], r.base_failed, r.kept) for r in quality_rules.apply_rules(docs, refs).collect())
    want = []
    for doc, text, _ in texts:
        counts = base_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        a, b, n = histograms(text)
        far = [max((distance([x / len(text) for x in a], q) / 0.27) if len(text) >= 200 else 0, (distance([x / n for x in b], w) / 0.80) if n >= 100 else 0) for q, w in refs.values()]
        want.append((str(doc), *counts, failed, not failed and min(far) <= 1))
    assert got == sorted(want)


def test_quality_rules_keep_clean_documents(spark):
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, quality_rules.references(docs)).collect()}
    labels = duckdb.sql("select doc_id, quality, text from '/root/testdata/sf0.01/labels.parquet' join '/root/testdata/sf0.01/documents.parquet' using (doc_id)").fetchall()
    good = [got[d] for d, q, t in labels if q == 1 and not got[d].base_failed]
    assert sum(r.kept for r in good) == len(good)
    junk = [got[d] for d, q, t in labels if q == 0 and re.search(r"\*\*\*|!! [A-Z]+!! ", t) and len(t) > 400]
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_quality_rules_edges(spark, clashing):
    docs = clashing
    assert quality_rules.references(docs.limit(0)) == {}
    assert quality_rules.apply_rules(docs.limit(0), {}).count() == 0
    out = quality_rules.apply_rules(docs, {}, keep=("doc_id", "m"))
    assert out.count() == docs.count()


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows[tuple(ws[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[w] if x is not None}
        out.append((str(doc), len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def items_of(spark, odd_rows):
    long_words = odd_rows[9][1].split()
    items = [(1, odd_rows[0][1][:300]), (1, odd_rows[0][1][:300]), (10, "TWO"), (2, " ".join(long_words[4080:4110])), (3, None), (4, "..."), (None, " ".join(long_words[8:20])), (5, "Same, line! same"), (7, "日本語 🎉 é")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_contamination(spark, odd_rows, clashing):
    items, frame = items_of(spark, odd_rows)
    got = sorted((str(r[0]), *r[1:]) for r in decontaminate.find_contamination(clashing, frame).collect())
    assert got == contamination([r[:2] for r in odd_rows], items)
    none = frame.limit(0)
    assert not any(r.contaminated for r in decontaminate.find_contamination(clashing, none).collect())
    assert decontaminate.find_contamination(clashing.limit(0), frame).count() == 0
    left = decontaminate.remove_contaminated(clashing, frame)
    assert left.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(x[0] for x in got if not x[5])


def test_contamination_without_broadcast(spark, odd_rows, clashing, monkeypatch):
    items, frame = items_of(spark, odd_rows)
    monkeypatch.setattr(decontaminate, "BROADCAST", -1)
    got = sorted((str(r[0]), *r[1:]) for r in decontaminate.find_contamination(clashing, frame).collect())
    assert got == contamination([r[:2] for r in odd_rows], items)


def test_contamination_sample(spark, sample):
    docs, items = (spark.read.parquet(f"{sample}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((str(r[0]), *r[1:]) for r in decontaminate.find_contamination(docs, items).collect())
    assert got == contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[5] for r in got)


def deduped(rows, size=3):
    """rows: (doc_id, text), distinct by both -> text without lines of later windows."""
    first, spans = {}, defaultdict(set)
    found = []
    for doc, text in rows:
        full = [(i, SPACE.sub(" ", x).strip(" ")) for i, x in enumerate((text or "").split("\n"))]
        full = [x for x in full if x[1]]
        for k in range(len(full) - size + 1):
            found.append((tuple(x[1] for x in full[k : k + size]), doc, text, full[k][0], full[k + size - 1][0]))
    for w, doc, text, a, _ in found:
        if w not in first or (doc, a) < first[w][:2]:
            first[w] = (doc, a, text)
    for w, doc, text, a, b in found:
        if (doc, a) != first[w][:2]:
            spans[doc, text] |= set(range(a, b + 1))
    return {(d, t): t if not spans.get((d, t)) else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in spans[d, t]) for d, t in rows}


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_line_dedup(spark, odd_rows, clashing, sample, which):
    docs = clashing if which == "odd" else spark.read.parquet(f"{sample}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    least = -(2**63)
    want = deduped(list(dict.fromkeys((least if d is None else d, t) for d, t in rows)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted((str(d), str(want[least if d is None else d, t])) for d, t in rows)
    report = line_dedup.dedup_report(docs).collect()
    assert sum(r.n_removed for r in report) > 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_words_three_ways(spark, odd_rows):
    """Packed and wide sorting, and brute force, also where upper parts of different hashes are alike (few bits are left of them)."""
    import random

    from pyspark.sql import functions as F

    from topiclog.llm.common import words

    rnd = random.Random(2)
    texts = [r[1] for r in odd_rows] + [" ".join(rnd.choices("abcd", k=rnd.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select("text", words(F.col("text")).alias("ws"))
    for place in (quality_rules.PLACE, 60, 3):
        for r in docs.select("ws", quality_rules.repeated_words(F.col("ws"), place=place).alias("n")).collect():
            threes = list(zip(r.ws, r.ws[1:], r.ws[2:]))
            again = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)} if len(threes) < 500 else None
            assert again is None or r.n == len(again), (place, r.ws[:20])


def test_quality_rules_of_many_languages(spark):
    """More languages than any table of them has room for: each has a reference, and judged() equals references() with apply_rules()."""
    rows = [(k * 2 + j, ("abcdefghij"[k % 10] * (2 + k % 7) + " the ") * 60 + f"w{j} " * j, f"l{k}") for k in range(90) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(docs)
    assert len(refs) == 90
    same = lambda frame: sorted(str((r.doc_id, r.kept, round(r.class_distance, 9), round(r.word_distance, 9))) for r in frame.collect())
    assert same(quality_rules.judged(docs)) == same(quality_rules.apply_rules(docs, refs))
    assert quality_rules.judged(docs.limit(0)).count() == 0 and quality_rules.keep_clean(docs.limit(0)).count() == 0


def test_each_histogram_alone_rejects(spark):
    """Noise of symbols fails by its classes, with word distances switched off, and foreign words fail by their words, with class distances switched off."""
    from conftest import prose

    clean = [(k, prose(k, 400) + " the of and to a in is that for was " * 12, "en") for k in range(30)]
    noise = [(100, " ".join(f"|{i}#| <w{i}>$ {i * 7}||" for i in range(200)), "en")]
    foreign = [(101, " ".join(f"{'der die und in den von zu'.split()[i % 7]} {chr(97 + i % 26) * 3}{chr(97 + i // 26)}" for i in range(150)), "en")]
    docs = spark.createDataFrame(clean + noise + foreign, "doc_id long, text string, lang string")
    kept = lambda **limits: {r.doc_id for r in quality_rules.judged(docs, **limits).collect() if r.kept}
    assert kept(word_limit=9.0, class_limit=0.27) == {*range(30), 101}
    assert kept(word_limit=0.5, class_limit=9.0) >= {*range(30)} and 101 not in kept(word_limit=0.5, class_limit=9.0)
