"""DuckDB SQL for what the operators return, where SQL can say it."""

from __future__ import annotations

import math

from heatgraph.llm.credentials import KINDS, ROLE, STRONG, WEAK
from heatgraph.llm.quality import RATES, Rules

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents)"


def substring_sql(window: int = 13) -> str:
    """The rows of ``substring_report``."""
    return f"""WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (g), range(0, {window}) t(k) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def quality_sql(rules: Rules = Rules(), width: int = 8) -> str:
    """The rows of ``quality_report``."""
    step = repr(math.log(rules.gamma))
    count = lambda c: f"(length(text) - length(regexp_replace(text, '{c}', '', 'g')))"

    def quartiles(n: int, keys: str) -> str:
        by = f"{keys}{', ' if keys else ''}rate"
        return f"""q{n} AS (SELECT {by}, max(total) AS total, min(CASE WHEN upto >= 0.25 * total THEN bucket END) AS low, min(CASE WHEN upto >= 0.75 * total THEN bucket END) AS high
FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {by})"""

    a, b = (f"{x}.total >= {rules.least_rows}" for x in "ab")
    wide = lambda x: f"({x}.high - {x}.low)"
    return f"""WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g), range(0, {width}) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
{count("[#*$%&|<>]")}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
{count("[!-/:-@\\[-`{-~]")} AS n_marks, {count("[A-Z]")} AS n_capitals, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
long AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS rate, ceil(ln(({x} + 1)::DOUBLE / ({y} + 1)::DOUBLE) / {step})::BIGINT AS bucket FROM c" for k, x, y in RATES)}),
sk AS (SELECT lang, source, rate, bucket, count(*) AS n FROM long GROUP BY ALL),
{quartiles(0, "lang, source")}, {quartiles(1, "lang")}, {quartiles(2, "")},
most AS (SELECT a.lang, a.source, a.rate, CASE WHEN {a} THEN a.high WHEN {b} THEN b.high ELSE c.high END + {rules.reach} * greatest(CASE WHEN {a} THEN {wide("a")} END, CASE WHEN {b} THEN {wide("b")} END, {wide("c")}) AS most
FROM q0 a JOIN q1 b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate JOIN q2 c ON a.rate = c.rate),
good AS (SELECT doc_id, bool_and(bucket <= most) AS good FROM long l JOIN most m ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source AND l.rate = m.rate GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
(NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND good) AS kept FROM c JOIN good USING (doc_id)"""


def secrets_sql(reach: int = 200) -> str:
    """The rows of ``secret_report``."""
    kinds, places = [], []
    for k, (name, pattern, group, least) in enumerate([*STRONG, *((n, p, 0, 0) for n, p, _ in WEAK)]):
        quoted = "'" + pattern.replace("'", "''") + "'"
        lengths = lambda g: f"list_transform(regexp_extract_all(t, {quoted}, {g}), lambda x: length(x))"  # noqa: B023, E731
        kinds.append(f"""k{k} AS (SELECT doc_id, {lengths(0)} AS lens, {lengths(group)} AS own, list_transform(string_split_regex(t, {quoted}), lambda x: length(x)) AS gaps FROM d WHERE regexp_matches(t, {quoted}))""")
        places.append(f"""SELECT doc_id, {k} AS kind, '{ROLE[name]}' AS role, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s, lens[i] AS n FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM k{k}) WHERE own[i] >= {least}""")
    blank = "chr(10) || '[ \\t\\r]*' || chr(10)"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda where: f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER ({where}), '')"
    count = lambda k: f"count(*) FILTER (kind = {k}) AS n_{KINDS[k]}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(kinds)},
parts AS (SELECT doc_id, kind, role, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({" UNION ALL ".join(places)})),
room AS (SELECT p.*, s - length(list_last(string_split_regex(substr(t, greatest(1, s - {reach} + 1), least({reach}, s)), {blank}))) AS lo,
e + length(string_split_regex(substr(t, e + 1, {reach}), {blank})[1]) AS hi FROM parts p JOIN d USING (doc_id)),
kept AS (SELECT doc_id, kind, s, e FROM parts WHERE kind < {len(STRONG)} UNION ALL SELECT doc_id, kind, s, e FROM room w WHERE kind >= {len(STRONG)}
AND EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND (o.role = 'secret') <> (w.role = 'secret') AND o.s <= w.hi AND o.e >= w.lo))
SELECT d.doc_id, {", ".join(count(k) for k in range(len(STRONG)))}, sha256({text(f"kind < {len(STRONG)}")}) AS base_sha256, {text("kind IS NOT NULL")} AS spans FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""
