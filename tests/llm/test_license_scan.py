"""Licence scans against whole licence texts and a brute-force reading of notices."""

import re

from topiclog.llm import license_scan as scan


def text_of(*names, wrap=0, mark=""):
    if mark:
        return f"\n{mark}\n".join(text_of(n, wrap=wrap).replace("\n", f"\n{mark}") for n in names)
    out = " ".join(scan.SENTENCES[n] for n in names)
    if wrap:
        words, lines = out.split(), [""]
        for w in words:
            if len(lines[-1]) + len(w) > wrap:
                lines.append("")
            lines[-1] += (" " if lines[-1] else mark) + w
        out = "\n".join(lines)
    return out


CASES = [
    ("", "", ""),
    (None, "", ""),
    ("no notice here", "", ""),
    ("words of prose | and\nLicensed under CC BY-NC 4.0.", "cc-by-nc", "CC-BY-NC-4.0"),
    ("Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose", "apache-notice", "Apache-2.0"),
    ("RELEASED   under the\tMIT license!", "mit-notice", "MIT"),
    (text_of("mit-grant", "mit-notice-kept", "mit-as-is", wrap=60), "mit-grant,mit-notice-kept,mit-as-is", "MIT"),
    (text_of("mit-notice-kept", "mit-grant", wrap=60), "mit-notice-kept,mit-grant", ""),
    (text_of("apache-header", "apache-copy", "apache-as-is", "apache-limits", wrap=70, mark="# "), None, "Apache-2.0"),
    (text_of("bsd-forms", "bsd-source", "bsd-binary", wrap=50), "bsd-forms,bsd-source,bsd-binary", "BSD-2-Clause"),
    (text_of("bsd-forms", "bsd-source", "bsd-binary", "bsd-names", wrap=50), None, "BSD-3-Clause"),
    (text_of("gpl-free", "gpl-hope", wrap=50), "gpl-free,gpl-hope", "GPL-3.0-or-later"),
    (text_of("gpl2-free", "gpl-hope", "gpl-details", wrap=50), "gpl2-free,gpl-hope,gpl-details", "GPL-2.0-or-later"),
    (text_of("mpl-form"), "mpl-form", "MPL-2.0"),
    ("Licensed under CC BY 4.0.\nx\nReleased under the MIT License.\nLicensed under CC BY 4.0.", "cc-by,mit-notice,cc-by", "CC-BY-4.0,MIT"),
    ("prose " * 30_000 + ". " + text_of("unlicense"), "unlicense", "Unlicense"),
    ("the license of permission", "", ""),
]


def test_cases(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)] + [(None, CASES[5][0])], "doc_id long, text string").selectExpr("*", "1 licenses", "2 sentence_ids")
    got = {r.doc_id: r for r in scan.scan(docs).collect()}
    for k, (_, ids, licences) in enumerate(CASES):
        assert got[k].licenses == licences, (k, got[k])
        assert ids is None or got[k].sentence_ids == ids, (k, got[k])
    assert got[None].licenses == "MIT"
    assert scan.scan(docs.limit(0)).count() == 0


def test_every_known_sentence_has_a_trigger_and_its_own_identifier(spark):
    assert all(re.search(scan.TRIGGER, s.lower()) for s in scan.SENTENCES.values())
    docs = spark.createDataFrame(list(scan.SENTENCES.items()), "doc_id string, text string")
    assert all(r.sentence_ids == r.doc_id for r in scan.scan(docs).collect())


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notice = {scan.normalised(scan.SENTENCES[n]): n for n in ("apache-notice", "mit-notice", "gpl3-notice", "cc-by-nc")}
    want = {r.doc_id: {notice[scan.normalised(x)] for x in r.text.split("\n") if scan.normalised(x) in notice} for r in docs.collect()}
    got = {r.doc_id: set(r.sentence_ids.split(",")) - {""} for r in scan.scan(docs).collect()}
    assert got == want and any(got.values())
