"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqjoin.operators.skewed import hot_keys, profile_keys
from seqjoin.sources.delimited import parse_reads


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 2: few keys, most rows

def _rec_keys() -> dict:
    return {"mseq": F.col("mseq"), "tnum": F.col("tnum")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _table(spark, sf_dir, "rec")
    return hot_keys(rec, _rec_keys(), 0.02).select("key_field", "key_value")


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_keys(_table(spark, sf_dir, "rec"), _rec_keys(), {"least_pos": F.col("pos")})


_P2 = """
SELECT 'mseq' AS key_field, mseq AS key_value, count(*) AS n_rows, count(DISTINCT tnum) AS n_partners, min(pos) AS least_pos FROM rec GROUP BY mseq
UNION ALL
SELECT 'tnum', CAST(tnum AS VARCHAR), count(*), count(DISTINCT mseq), min(pos) FROM rec GROUP BY tnum
"""

# 6: lines that fail to parse


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reads(_table(spark, sf_dir, "raw_reads")).where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reads(_table(spark, sf_dir, "raw_reads")).where(F.col("reason").isNull()).select("raw_id", "read_name", "seq")


_FIELD = '("([^"]|"")*"|[^",]*)'
_P6 = rf"""
SELECT raw_id,
  CASE WHEN NOT ok THEN 'quoting'
    WHEN fields IS NULL OR fields <> 4 THEN 'column_count'
    WHEN NOT regexp_matches(read_name, '^[@>]\S') THEN 'bad_name'
    WHEN NOT regexp_full_match(seq, '[ACGTNacgtn]+') THEN 'bad_seq' END AS reason,
  read_name, seq
FROM (
  SELECT raw_id, ok, fields,
    CASE WHEN f1 LIKE '"%' THEN replace(substr(f1, 2, length(f1) - 2), '""', '"') ELSE f1 END AS read_name,
    CASE WHEN f2 LIKE '"%' THEN replace(substr(f2, 2, length(f2) - 2), '""', '"') ELSE f2 END AS seq
  FROM (
    SELECT raw_id, raw_line IS NULL OR regexp_full_match(raw_line, '{_FIELD}(,{_FIELD})*', 's') AS ok,
      length(regexp_replace(regexp_replace(raw_line, '"([^"]|"")*"', 'q', 'g'), '[^,]', '', 'gs')) + 1 AS fields,
      regexp_extract(raw_line, '^{_FIELD}', 1, 's') AS f1,
      regexp_extract(raw_line, '^{_FIELD},{_FIELD}', 3, 's') AS f2
    FROM raw_reads
  )
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_profile": p2_profile,
        "p6_found": p6_found,
        "p6_loaded": p6_loaded,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT key_field, key_value FROM ({_P2}) WHERE key_value <> '' AND n_rows >= 0.02 * (SELECT count(*) FROM rec)",
        "p2_profile": _P2,
        "p6_found": f"SELECT raw_id, reason FROM ({_P6}) WHERE reason IS NOT NULL",
        "p6_loaded": f"SELECT raw_id, read_name, seq FROM ({_P6}) WHERE reason IS NULL",
    }
