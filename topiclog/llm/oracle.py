"""DuckDB SQL for the operators that SQL can express."""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w))),
hit AS (SELECT rid, i, k, item FROM dw JOIN w USING (w, k)),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
f AS (SELECT rid, doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM l),
w AS (SELECT rid, doc_id, i AS a, lead(i, 2) OVER r AS z, concat_ws(chr(10), s, lead(s, 1) OVER r, lead(s, 2) OVER r) AS w FROM f WHERE s <> '' WINDOW r AS (PARTITION BY rid ORDER BY i)),
o AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS k FROM w WHERE z IS NOT NULL),
gone AS (SELECT DISTINCT rid, unnest(range(a, z + 1)) AS i FROM o WHERE k > 1),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN gone g ON g.rid = l.rid AND g.i = l.i WHERE g.i IS NULL GROUP BY l.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, CASE WHEN n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def quality_rules() -> str:
    """The rules with their default limits: base counts, references over all documents, and both distances."""
    from topiclog.llm.quality_rules import COMMON_WORDS

    vocabulary = sorted({w for own in COMMON_WORDS.values() for w in own})
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
r AS (SELECT *, regexp_replace(t, '\p{{Ll}}+', '', 'g') AS r1 FROM d),
r2 AS (SELECT *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') AS r2 FROM r),
r3 AS (SELECT *, regexp_replace(r2, '\p{{Lu}}+', '', 'g') AS r3 FROM r2),
r4 AS (SELECT *, regexp_replace(r3, '\p{{N}}+', '', 'g') AS r4 FROM r3),
r5 AS (SELECT *, regexp_replace(r4, '[.,;:!?''"()-]+', '', 'g') AS r5 FROM r4),
r6 AS (SELECT *, regexp_replace(r5, '[\p{{L}}\p{{M}}]+', '', 'g') AS r6, regexp_extract_all(lower(t), '\p{{L}}+') AS known,
  regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM r5),
m AS (SELECT rid, doc_id, lang, length(t) AS n_chars, len(known) AS n_known, known, ws, ls,
  [length(t) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5), length(r5) - length(r6), length(r6)] AS classes,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols FROM r6),
g AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM m)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(*) AS n_repeat FROM (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY rid),
vocabulary AS (SELECT unnest({_list(vocabulary)}) AS w),
words AS (SELECT rid, w, count(*) AS c FROM (SELECT rid, unnest(known) AS w FROM m) JOIN vocabulary USING (w) GROUP BY ALL),
histogram AS (
  SELECT rid, lang, 'c' AS kind, CAST(k AS VARCHAR) AS k, classes[k + 1] AS c, n_chars AS n FROM m, range(7) AS x(k)
  UNION ALL SELECT rid, lang, 'w', v.w, coalesce(words.c, 0), n_known FROM m CROSS JOIN vocabulary v LEFT JOIN words USING (rid, w)
  UNION ALL SELECT rid, lang, 'w', '', n_known - coalesce((SELECT sum(c) FROM words WHERE words.rid = m.rid), 0), n_known FROM m),
refs AS (SELECT lang, kind, k, sum(c) / CAST(sum(n) AS DOUBLE) AS q FROM histogram GROUP BY ALL),
terms AS (SELECT h.rid, refs.lang, kind, c / CAST(n AS DOUBLE) AS p, q FROM histogram h JOIN refs USING (kind, k) WHERE n >= CASE kind WHEN 'c' THEN 200 ELSE 100 END),
far AS (SELECT rid, lang, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM terms GROUP BY ALL),
each_lang AS (SELECT m.rid, l.lang, coalesce(max(d) FILTER (kind = 'c'), 0) AS dc, coalesce(max(d) FILTER (kind = 'w'), 0) AS dw
  FROM m CROSS JOIN (SELECT DISTINCT lang FROM refs) l LEFT JOIN far ON far.rid = m.rid AND far.lang = l.lang GROUP BY ALL),
best AS (SELECT rid, min(struct_pack(worst := greatest(dc / 0.27, dw / 0.8), c := dc, w := dw)) AS b FROM each_lang GROUP BY rid),
f AS (SELECT m.*, coalesce(n_repeat, 0) AS n_repeat, b, len(ws) < 50 OR 100 * coalesce(n_repeat, 0) > 50 * len(ws) AS failed FROM m LEFT JOIN rep USING (rid) JOIN best USING (rid))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat AS n_repeat_words,
  failed AS base_failed, NOT failed AND b.worst <= 1 AS kept, round(b.c, 6) AS class_distance, round(b.w, 6) AS word_distance FROM f
"""


def license_scan() -> str:
    """The same pieces, identifiers and rules, over lists."""
    from topiclog.llm.license_scan import NOTICE, PART_OF, TRIGGER, UNDER, notices, piece_table, rules

    known, patterns = piece_table()
    forms = notices()

    def ids(cut: str) -> str:
        clean = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')"
        notice = f"list_extract({_list(f'<{i}>' for i in forms.values())}, list_position({_list(forms)}, regexp_replace(x, {_text(NOTICE)}, {_text(UNDER)})))"
        numbers = f"list_transform({clean}, lambda x: coalesce(CAST(list_position({_list(known)}, x) - 1 AS VARCHAR), {notice}, '-'))"
        out = f"regexp_replace(' ' || array_to_string({numbers}, '  ') || ' ', '(?: - )+', ' - ', 'g')"
        for name, own in sorted(patterns, key=lambda p: (-len(p[1].split()), p[0])):
            out = f"replace({out}, {_text(own)}, {_text(f'<{name}>')})"
        return f"array_to_string(regexp_extract_all({out}, '<[^>]+>'), '')"

    fits = lambda names: " OR ".join(f"regexp_matches({c}, {_text(''.join(f'<{n}>.*' for n in names))})" for c in ("over_ids", "line_ids"))
    named: dict[str, list[str]] = {}
    for licence, names in rules():
        named.setdefault(licence, []).append(fits(names))
    columns = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN {_text(name)} END" for name, tests in sorted(named.items()))
    drop = " OR ".join(f"(x = {_text(part)} AND list_contains(found, {_text(whole)}))" for part, whole in PART_OF.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(lower(coalesce(text, '')), {_text(TRIGGER)}) AS hinted FROM documents),
c AS (SELECT doc_id, hinted, regexp_replace(regexp_replace(regexp_replace(t, '(?i)spdx-license-identifier[ \t]*:', 'SPDX-License-Identifier ', 'g'), '\n[ \t\r#*/;-]*\n', chr(1), 'g'), '([.!?;:])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g') AS cut FROM d),
i AS (SELECT doc_id, CASE WHEN hinted THEN {ids("cut")} ELSE '' END AS over_ids, CASE WHEN hinted THEN {ids("replace(cut, chr(10), chr(1))")} ELSE '' END AS line_ids FROM c),
n AS (SELECT *, list_filter([{columns}], lambda x: x IS NOT NULL) AS found FROM i),
l AS (SELECT *, list_sort(list_filter(found, lambda x: NOT ({drop}))) AS licences FROM n)
SELECT doc_id, replace(regexp_replace(CASE WHEN length(line_ids) > length(over_ids) THEN line_ids ELSE over_ids END, '^<|>$', '', 'g'), '><', ',') AS sentence_ids,
  coalesce(array_to_string(licences, ','), '') AS licenses, CAST(len(licences) AS BIGINT) AS n_licenses FROM l
"""


def url_filter() -> str:
    """Explicit rules, then every rule of up to seven tokens that is frequent and sure enough, by listing all sets of tokens of each blocked page.

    Here each token is an item of its own; which rules fit a page comes to the same.
    """
    from topiclog.llm.url_filter import RULES

    rules = ", ".join(f"({_text(verdict)}, {_text(rule)}, {_text(rule.partition('/')[0])}, {_text('/' + rule.partition('/')[2])})" for verdict, rule in RULES)
    part = lambda column, mark: f"list_transform(list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_matches(x, '[^\\p{{N}}]')), lambda x: '{mark}' || x)"
    return rf"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS rid, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {LETTERS}) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS (SELECT *, list_distinct(list_concat({part("host", "h:")}, {part("path", "p:")})) AS items, TRY_CAST(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') AS BIGINT) AS number FROM p),
marks AS (SELECT doc_id, max(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS block FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT rid, items, block FROM t JOIN marks ON t.number = marks.doc_id),
least AS (SELECT greatest(20, CAST(ceil(0.002 * count(*)) AS BIGINT)) AS s FROM b),
known AS (SELECT token FROM (SELECT block, unnest(items) AS token FROM b) GROUP BY token HAVING count(*) FILTER (block) >= (SELECT s FROM least)),
own AS (SELECT rid, list(token ORDER BY token) AS items FROM (SELECT rid, unnest(items) AS token FROM b WHERE block) JOIN known USING (token) GROUP BY rid),
sets AS (SELECT rid, items, 0 AS upto, CAST([] AS VARCHAR[]) AS s FROM own
  UNION ALL SELECT rid, items, k.i, list_append(s, items[k.i]) FROM sets, LATERAL (SELECT unnest(range(upto + 1, len(items) + 1)) AS i) AS k WHERE len(s) < 7),
often AS (SELECT s, count(*) AS n_block FROM sets WHERE len(s) > 0 GROUP BY s HAVING count(*) >= (SELECT s FROM least)),
sure AS (SELECT s, n_block / CAST(count(*) AS DOUBLE) AS confidence FROM often JOIN b ON list_has_all(b.items, often.s) GROUP BY s, n_block HAVING n_block / CAST(count(*) AS DOUBLE) >= 0.6),
bad AS (SELECT DISTINCT rid FROM t JOIN sure ON list_has_all(t.items, sure.s)),
r AS (SELECT * FROM (VALUES {rules}) AS v(verdict, rule, name, rest)),
best AS (SELECT rid, arg_max(struct_pack(rule, verdict), struct_pack(size := length(rule), rule := rule)) AS r
  FROM t JOIN r ON (t.host = r.name OR ends_with(t.host, '.' || r.name)) AND starts_with(t.path, r.rest) GROUP BY rid)
SELECT page_id, host, path, best.r.rule AS rule, coalesce(best.r.verdict, CASE WHEN bad.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN best USING (rid) LEFT JOIN bad USING (rid)
"""
