"""SQL twin of the licence scan. The spellings and the pattern are written out anew from the same fixed values."""

from __future__ import annotations

from flightlens.llm.license_texts import LICENSES, NOTICES
from flightlens.llm.licenses import SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(texts: dict[str, str]) -> str:
    return ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in texts.items())


_FOLD = (
    r"regexp_replace(regexp_replace(lower(text), '(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^a-z0-9\n]*(?:\(c\)|©)?[^a-z0-9\n]*"
    r"(?:[0-9]{4}|year|yyyy)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$', '', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g')"
)
_CASES = " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in SPELLINGS.items())
_SPELL = f"array_to_string(list_transform(string_split(x, ' '), lambda w: CASE w {_CASES} ELSE w END), ' ')"

ORACLES = {
    "op1_license_scan": f"""
WITH known(kind, name, text) AS (SELECT 'text', * FROM (VALUES {_values(LICENSES)}) UNION ALL SELECT 'line', * FROM (VALUES {_values(NOTICES)})),
kf AS (SELECT kind, name, trim(regexp_replace({_FOLD}, '[ \\n]+', ' ', 'g')) AS x FROM known),
k AS (SELECT kind, {_SPELL} AS c, min(name) AS name FROM kf GROUP BY kind, c),
d AS (SELECT doc_id, row_number() OVER () AS r, {_FOLD} AS f FROM documents),
w AS (SELECT r, trim(regexp_replace(f, '[ \\n]+', ' ', 'g')) AS x FROM d),
t AS (SELECT r, {_SPELL} AS c FROM w WHERE length(x) < 10000),
e AS (SELECT r, trim(unnest(string_split(f, chr(10)))) AS x FROM d),
n AS (SELECT r, name FROM (SELECT r, {_SPELL} AS c FROM e WHERE length(x) BETWEEN 1 AND 1000) JOIN k USING (c) WHERE kind = 'line'),
g AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM n GROUP BY r)
SELECT d.doc_id, k.name AS license, coalesce(g.n_notices, 0) AS n_notices, coalesce(g.notices, '') AS notices
FROM d LEFT JOIN g USING (r) LEFT JOIN t USING (r) LEFT JOIN k ON k.kind = 'text' AND k.c = t.c
""",
}
