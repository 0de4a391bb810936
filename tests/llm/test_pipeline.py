"""The pipeline against its stages by brute force."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def first_of_groups(rows):
    """(doc_id, text) of the rows that stay, by comparing all pairs; rows: (doc_id, text)."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, group = [grams(t) for _, t in distinct], list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted({min(k for k in range(len(group)) if group[k] == g) for g in group}), distinct, group


def test_stages(spark, clashing, sample):
    docs, seen = clashing, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sample)
        assert out.columns == docs.columns, name
        out = out.cache()
        seen.append((docs, out))
        docs = out
    ids = lambda frame: sorted(str(r.doc_id) for r in frame.select("doc_id").collect())
    assert ids(seen[0][1]) == sorted(["0", "1", "1", "2", "None", "6", "7", "15", "-5"])
    assert ids(seen[1][1]) == ids(seen[0][1])
    stay, distinct, _ = first_of_groups([(r.doc_id, r.text) for r in seen[2][0].collect()])
    assert ids(seen[2][1]) == sorted(str(distinct[k][0]) for k in stay)
    assert ids(seen[3][1]) == ids(seen[2][1])
    empty = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sample).count() == 0


def test_near_duplicates_lose_no_document(spark, clashing, sample):
    """Different texts under one id, or under none, stay; near copies go, whatever their ids; rows that repeat are one."""
    from conftest import prose

    one, two, three = prose(21, 120), prose(22, 120), prose(23, 120)
    more = [(50, one), (50, two), (50, two), (51, two + " end"), (None, three), (None, three + " end"), (None, prose(24, 80)), (52, "the end " + three), (53, None), (54, ""), (None, " ")]
    extra = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = clashing.unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, docs, sample).collect()]
    _, distinct, group = first_of_groups(rows)
    place = {r: g for r, g in zip(distinct, group)}
    assert len(kept) == len(set(group)) == len({place[r] for r in kept})
    for r in kept:  # the smallest id of its group
        assert (r[0] is None, r[0] or 0) == min((d is None, d or 0) for d, t in distinct if place[d, t] == place[r])
    assert {(50, one), (50, two), (52, "the end " + three)} <= set(kept) and (51, two + " end") not in kept


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    every = {d for (d,) in duckdb.sql(f"select doc_id from '{sf}/documents.parquet'").fetchall()}
    kept = {r.doc_id for r in rows}
    assert kept < every
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert kept == {r.doc_id for r in docs.collect()}
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)
    assert len(kept) == len({r.text for r in docs.collect()})


def test_a_named_run_goes_on(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    calls, stages = [], corpus_pipeline.STAGES
    counted = [(name, lambda s, d, f, name=name, stage=stage: (calls.append(name), stage(s, d, f))[1]) for name, stage in stages]

    def broken(s, d, f):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*counted[:2], ("broken", broken), *counted[3:]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, "resumed")
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    rows = corpus_pipeline.run(spark, sf, "resumed").collect()
    assert calls == [name for name, _ in stages] and rows
    assert corpus_pipeline.run(spark, sf, "resumed").count() == len(rows) and len(calls) == len(stages)
