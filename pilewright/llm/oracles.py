"""Independent SQL for the pN_ queries that SQL can state on whole tables."""

from __future__ import annotations

_P1 = """
WITH firsts AS (SELECT name, seq, min(batch_no) AS batch_no FROM reads GROUP BY name, seq),
hashed AS (
  SELECT *, md5(concat_ws(chr(31), 'pileup-page', CASE WHEN name IS NULL THEN '-' ELSE '+' || name END, CASE WHEN seq IS NULL THEN '-' ELSE '+' || seq END)) AS sample_hash
  FROM firsts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY sample_hash, name NULLS FIRST, seq NULLS FIRST) AS r, count(*) OVER (PARTITION BY batch_no) AS n
  FROM hashed)
SELECT batch_no, name, seq, sample_hash FROM ranked WHERE r <= (n + 9) // 10
"""

_P2 = """
WITH once AS (SELECT DISTINCT row_id, group_id, spec FROM pileup_rows WHERE spec IS NOT NULL),
kept AS (
  SELECT row_id, construct_id, length(ref_seq) AS w, length(ref_seq) - length(ltrim(spec, '-')) AS a, length(rtrim(spec, '-')) AS z,
    array_to_string(list_transform(range(1, length(ref_seq) + 1), lambda i: CASE WHEN spec[i] = '.' THEN upper(ref_seq[i]) ELSE upper(spec[i]) END), '') AS t
  FROM once JOIN pileup_groups USING (group_id)),
pairs AS (
  SELECT x.row_id AS row_a, y.row_id AS row_b, greatest(x.a, y.a) AS a, least(x.z, y.z) AS z, x.t AS t, y.t AS u
  FROM kept x JOIN kept y ON x.construct_id = y.construct_id AND x.row_id < y.row_id)
SELECT row_a, row_b FROM pairs WHERE hamming(t[a + 1:z], u[a + 1:z]) <= 0.06 * (z - a)
"""

_P3_RUNS = """
WITH once AS (SELECT DISTINCT group_id, read_ord, spec, seen_at FROM pileup_rows),
kept AS (
  SELECT o.*, upper(g.ref_seq) AS ref, length(g.ref_seq) AS w FROM once o JOIN pileup_groups g USING (group_id)),
spans AS (
  SELECT *, w - length(ltrim(spec, '-')) AS a, length(rtrim(spec, '-')) AS z FROM kept),
steps AS (
  SELECT *, lag(spec) OVER q AS pspec, lag(a) OVER q AS pa, lag(z) OVER q AS pz FROM spans WINDOW q AS (PARTITION BY group_id ORDER BY read_ord)),
diffs AS (
  SELECT group_id, read_ord, seen_at,
    CASE WHEN spec IS NULL OR pspec IS NULL THEN 99 ELSE
      len(list_filter(range(greatest(a, pa) + 1, least(z, pz) + 1), lambda i:
        (CASE WHEN spec[i] = '.' THEN ref[i] ELSE upper(spec[i]) END) <> (CASE WHEN pspec[i] = '.' THEN ref[i] ELSE upper(pspec[i]) END))) END AS d
  FROM steps),
numbered AS (
  SELECT *, sum(CASE WHEN d > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY read_ord) AS run FROM diffs)
SELECT group_id, min(read_ord) AS first_ord, max(read_ord) AS last_ord, count(*) AS n_rows,
  CAST(epoch_us(max_by(seen_at, read_ord)) - epoch_us(min_by(seen_at, read_ord)) AS BIGINT) AS duration_us
FROM numbered GROUP BY group_id, run HAVING count(*) > 1
"""

_P5 = """
WITH once AS (
  SELECT DISTINCT variant_id, group_id, pos,
    CASE lower(trim(consequence)) WHEN 'frameshift' THEN 0 WHEN 'nonsense' THEN 1 WHEN 'inframe_indel' THEN 2 WHEN 'missense' THEN 3 WHEN 'silent' THEN 4 WHEN 'noncoding' THEN 5 ELSE 6 END AS tier,
    CASE WHEN "count" IS NULL OR depth IS NULL OR depth = 0 THEN 0.0 ELSE "count" / depth END AS share
  FROM variants),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY tier, share DESC, pos NULLS FIRST, variant_id) AS r FROM once)
SELECT group_id, CAST(r AS INTEGER) AS rank_no, variant_id FROM ranked WHERE r <= 5
"""

ORACLES: dict[str, str] = {
    "p1_sample": _P1,
    "p2_found": _P2,
    "p3_runs": _P3_RUNS,
    "p3_found": f"SELECT group_id, first_ord, last_ord FROM ({_P3_RUNS})",
    "p5_found": _P5,
}
