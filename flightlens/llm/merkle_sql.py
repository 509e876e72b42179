"""SQL twin of the manifest query: levels are written out, enough of them for 16**8 documents and sources."""

LEVELS = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shown(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _storey(name: str) -> str:
    """Levels of the trees in ``{name}0`` (tree, pos, n, digest) and folds of ``{name}f0`` (rid, tree, pos, proof, folded)."""
    parts = []
    for k in range(LEVELS):
        at, up = f"{name}{k}", f"{name}{k + 1}"
        parts.append(f"""
{name}g{k} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, n, list(digest ORDER BY pos) AS ds FROM {at} GROUP BY tree, pos // 16, n),
{up} AS MATERIALIZED (SELECT tree, pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest
  FROM {name}g{k}),
{name}f{k + 1} AS MATERIALIZED (SELECT f.rid, f.tree, f.pos // 16 AS pos,
    CASE WHEN g.n = 1 THEN f.proof ELSE f.proof || array_to_string(g.ds[1:f.pos % 16], '') || array_to_string(g.ds[f.pos % 16 + 2:], '') END AS proof,
    CASE WHEN g.n = 1 THEN f.folded ELSE sha256(array_to_string(g.ds[1:f.pos % 16], '') || f.folded || array_to_string(g.ds[f.pos % 16 + 2:], ''))
    END AS folded
  FROM {name}f{k} f JOIN {name}g{k} g ON f.tree = g.tree AND f.pos // 16 = g.pos)""")
    return ",".join(parts)


_HEAD = " || ".join(map(_shown, ("doc_id", "source", "lang", "n_chars")))

ORACLES = {
    "op11_merkle_manifest": f"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS steps),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree,
    sha256({_HEAD} || {_shown("text")}) AS digest,
    sha256({_HEAD} || {_shown(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")}) AS other,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))) % 5 = 0 AS tampered
  FROM documents, t),
s0 AS MATERIALIZED (SELECT rid, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n, digest FROM d),
sf0 AS (SELECT s0.rid, s0.tree, s0.pos, '' AS proof, CASE WHEN d.tampered THEN d.other ELSE d.digest END AS folded
  FROM s0 JOIN d ON s0.rid = d.rid),{_storey("s")},
t0 AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM s{LEVELS}),
tf0 AS (SELECT f.rid, '' AS tree, t0.pos, f.proof, f.folded FROM sf{LEVELS} f JOIN t0 ON f.tree = t0.name),{_storey("t")}
SELECT d.doc_id, d.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root,
  f.folded = r.digest AS verified
FROM d JOIN s{LEVELS} s ON d.tree = s.tree JOIN tf{LEVELS} f ON f.rid = d.rid CROSS JOIN t{LEVELS} r
""",
}
