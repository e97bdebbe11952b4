"""Queries over unparsed read records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pilewright.operators.parse_records import parse_records, valid_and_rejected
from pilewright.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = valid_and_rejected(parse_records(table(spark, sf_dir, "raw_reads")))[1]
    return rejected.select("raw_id", "reason")


def p6_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_and_rejected(parse_records(table(spark, sf_dir, "raw_reads")))[0]


_CELL = """(?:"(?:[^"]|"")*"|[^",]*)"""

_P6 = f"""
WITH lines AS (SELECT raw_id, CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END AS t FROM raw_reads),
cells AS (
  SELECT raw_id, t, coalesce(regexp_full_match(t, '{_CELL}(?:,{_CELL})*'), FALSE) AS quoted_well,
    list_transform(regexp_extract_all(',' || t, ',({_CELL})', 1), lambda c: CASE WHEN starts_with(c, '"') THEN replace(c[2:-2], '""', '"') ELSE c END) AS f
  FROM lines),
judged AS (
  SELECT *,
    CASE WHEN t IS NULL OR t = '' THEN 'columns' WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 6 THEN 'columns'
      WHEN NOT (regexp_full_match(f[1], '[^\\s\\x0b\\x85\\xa0]+') AND regexp_full_match(f[2], '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+')
        AND (f[3] = '' OR (regexp_full_match(f[3], '[!-~]+') AND length(f[3]) = length(f[2])))
        AND regexp_full_match(f[4], '[0-9]+') AND coalesce(TRY_CAST(f[4] AS BIGINT) = length(f[2]), FALSE)
        AND regexp_full_match(f[5], 'bc[0-9][0-9]')
        AND regexp_full_match(f[6], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND TRY_CAST(f[6] AS TIMESTAMP) IS NOT NULL AND f[6][12:13] < '24') THEN 'value' END AS reason
  FROM cells)
"""

QUERIES = {"p6_found": p6_found, "p6_reads": p6_reads}

ORACLES = {
    "p6_found": f"{_P6} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_reads": f"{_P6} SELECT raw_id, f[1] AS name, f[2] AS seq, f[3] AS qual, CAST(f[4] AS INTEGER) AS n_bases, f[5] AS barcode, CAST(f[6] AS TIMESTAMP) AS read_at FROM judged WHERE reason IS NULL",
}
