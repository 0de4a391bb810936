"""Notices in many wordings, SPDX tags, rows that repeat, and the DuckDB SQL on them."""

import duckdb
import pytest

from topiclog.llm import license_scan as scan
from topiclog.llm import oracle

CASES = [
    ("This code is released under the MIT License.", "MIT"),
    ("All source files are licensed under the terms of the Apache License, Version 2.0!", "Apache-2.0"),
    ("// SPDX-License-Identifier: BSD-3-Clause\nint main;", "BSD-3-Clause"),
    ("# spdx-license-identifier : GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0+", ""),
    ("The library is distributed under the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This project is available under the GNU Affero General Public License v3.0.", "AGPL-3.0-only"),
    ("Made available under CC0.", "CC0-1.0"),
    ("Published by the\nEclipse Public License 2.0.", "EPL-2.0"),
    ("Our data are shared under the Open Database License.", "ODbL-1.0"),
    ("Released under a licence of our own.", ""),
    ("He lives under the MIT License.", ""),
    ("The road is covered by the snow. Available under the counter.", ""),
    ("Licensed under CC BY-ND 4.0.\nReleased under the zlib licence.", "CC-BY-ND-4.0,Zlib"),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def rows():
    return [(k, t) for k, (t, _) in enumerate(CASES)] * 2


def test_notices(spark, rows):
    got = scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licenses) for r in got) == sorted((k, CASES[k][1]) for k, _ in rows)


def test_every_notice_has_a_trigger_and_names_its_licence(spark):
    forms = scan.notices()
    assert len(forms) > 400
    texts = [(f, i.split("-", 1)[1]) for f, i in forms.items()]
    written = [("released " + f if f.startswith(scan.UNDER) else f, want) for f, want in texts]
    got = scan.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(written)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: want for k, (_, want) in enumerate(written)}


def test_sql_reads_the_same(spark, rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)").executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(oracle.license_scan()).fetchall())
    assert sorted(map(tuple, scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want
