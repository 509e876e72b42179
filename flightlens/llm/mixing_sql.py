"""SQL twin of the mixing query."""

ORACLES = {
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
a AS (SELECT *, CAST(coalesce(sum(3 * source_size) OVER cheap, 0) AS BIGINT) AS cap_before,
    CAST(coalesce(sum(w) OVER cheap, 0) AS BIGINT) AS w_before,
    CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weights
  FROM s WINDOW cheap AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, 3 * source_size * (weights - w_before) <= w * (total - cap_before) AS capped FROM a),
l AS (SELECT CAST(total - cap_before AS DOUBLE) / (weights - w_before) AS level FROM b WHERE NOT capped
  ORDER BY source_size / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE w * (SELECT level FROM l) END AS target,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 4) AS BIGINT) AS DOUBLE) / 65536.0 AS u
  FROM b),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS f,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(d.size)) * 4 + ((d.size - (1 << (length(bin(d.size)) - 1))) * 4) // (1 << (length(bin(d.size)) - 1)),
      d.h, d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor(k * f + u) - floor((k - 1) * f + u), 3) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
""",
}
