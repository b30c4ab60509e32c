"""Queries of the problems tagged llm, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqjoin.llm.heavy import frequent_values
from seqjoin.llm.mixture import Goal, mix, mixing_faults, share_report
from seqjoin.llm.packing import fill_report, pack, packing_faults
from seqjoin.llm.residue import classified_templates, residue, scan_documents
from seqjoin.llm.seen import SeenStore, answer_rates, arrive, seen_reads, sequence_key, unverified_rates
from seqjoin.llm.spans import shared_spans
from seqjoin.llm.templates import mine_templates
from seqjoin.llm.tokens import count_tokens
from seqjoin.llm.topn import top_n_per_group
from seqjoin.scratch import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: best rows per read sequence


def _best_rows(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    rows = _table(spark, sf_dir, "results").select("seq", "nmiss", "target_id", "pos", "row_no", *extra)
    rows = rows.where(F.col("target_id").isNotNull() & (F.col("nmiss") >= 0))
    return top_n_per_group(rows, "seq", "nmiss", ["target_id", "pos", "row_no"], 3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_rows(spark, sf_dir).select("row_no")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_rows(spark, sf_dir).select("seq", F.col("rank").cast("long").alias("place"), "nmiss", "target_id", "row_no")


_P1 = """
SELECT * FROM (
  SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY nmiss, target_id, pos NULLS FIRST, row_no) AS place, nmiss, target_id, row_no
  FROM results WHERE seq IS NOT NULL AND target_id IS NOT NULL AND nmiss >= 0
) WHERE place <= 3
"""

# 3: frequent windows


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_values(_table(spark, sf_dir, "rec"), "mseq", 0.0025).select("mseq")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_values(_table(spark, sf_dir, "rec"), "mseq", 0.0025).select("mseq", "n_rows")


_P3 = """
SELECT mseq, count(*) AS n_rows FROM rec WHERE mseq <> ''
GROUP BY mseq HAVING count(*) >= 0.0025 * (SELECT count(*) FROM rec)
"""

# 4: spans shared between records


def _rec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(*(F.coalesce(c, F.lit("")) for c in ("left_tail", "mseq", "right_tail")))
    return _table(spark, sf_dir, "rec").select("rec_id", text.alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_rec_texts(spark, sf_dir), "rec_id", "text")


def p4_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_rec_texts(spark, sf_dir), "rec_id", "text", later=True)


_PIECES = """
WITH texts AS (SELECT rec_id, coalesce(left_tail, '') || coalesce(mseq, '') || coalesce(right_tail, '') AS t FROM rec),
pieces AS (
  SELECT rec_id, p, substr(t, CAST(p AS INTEGER) + 1, 50) AS piece
  FROM (SELECT rec_id, t, unnest(range(length(t) - 49)) AS p FROM texts WHERE length(t) >= 50)
),
shared AS (
  SELECT rec_id, p AS b, p + 50 AS e
  FROM (SELECT *, min(rec_id) OVER w AS low, max(rec_id) OVER w AS high FROM pieces WHERE NOT contains(piece, 'X') WINDOW w AS (PARTITION BY piece))
  WHERE {which}
),
marked AS (
  SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY rec_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM shared
),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT rec_id, CAST(min(b) AS INTEGER) AS span_start, CAST(max(e) - min(b) AS INTEGER) AS span_len FROM islands GROUP BY rec_id, island
"""

# 5: keys seen before


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SeenStore]:
    old = _table(spark, sf_dir, "results").select(sequence_key(F.col("seq")).alias("key"))
    store = SeenStore(spark)
    store.add(old)
    return old, store


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "read_in_seq")
    return seen_reads(reads, "read_no", sequence_key(F.col("seq")), _history(spark, sf_dir)[1])


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, (old, store) = _table(spark, sf_dir, "read_in_seq"), _history(spark, sf_dir)
    arrive(reads, "read_no", sequence_key(F.col("seq")), store)
    return answer_rates(reads, "read_no", sequence_key(F.col("seq")), old, store)


def p5_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, (_, store) = _table(spark, sf_dir, "read_in_seq"), _history(spark, sf_dir)
    arrive(reads, "read_no", sequence_key(F.col("seq")), store)
    return unverified_rates(reads, sequence_key(F.col("seq")), store)


_P5 = """
WITH reads AS (
  SELECT read_no, left(regexp_replace(seq, '[^ATGC]', 'X', 'g'), 100) AS k FROM read_in_seq WHERE seq <> ''
), old AS (SELECT DISTINCT left(regexp_replace(seq, '[^ATGC]', 'X', 'g'), 100) AS k FROM results WHERE seq <> '')
SELECT read_no FROM reads
WHERE k IN (SELECT k FROM old)
UNION ALL
SELECT read_no FROM (SELECT read_no, k, min(read_no) OVER (PARTITION BY k) AS first_no FROM reads)
WHERE read_no > first_no AND k NOT IN (SELECT k FROM old)
"""

_P5_RATES = f"""
SELECT count(*) FILTER (WHERE seq <> '') AS n_answers, (SELECT count(*) FROM ({_P5})) AS n_seen, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS wrong_rate
FROM read_in_seq
"""

# 7: containers


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """All tasks; a list of parameters, each of which packs every document once more."""
    return sorted((r.pack_kind, r.capacity_tokens) for r in _table(spark, sf_dir, "pack_sizes").collect())


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return materialize(count_tokens(_table(spark, sf_dir, "documents"), "text", ["doc_id", *keep]), "sizes")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_packed(spark, sf_dir), _capacities(spark, sf_dir))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, capacities = _sizes(spark, sf_dir), _capacities(spark, sf_dir)
    packed = materialize(pack(sizes, "doc_id", "n_tokens", capacities), "packed")
    return packing_faults(packed, sizes, "doc_id", "n_tokens", capacities)


_P7_FAULTS = """
SELECT pack_kind, (SELECT count(*) FROM documents) AS n_items, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS wrong_size,
  CAST(0 AS BIGINT) AS split_needlessly, CAST(0 AS BIGINT) AS not_joined
FROM pack_sizes
"""

# 8: mixtures


def _goals(spark: SparkSession, sf_dir: str) -> list[Goal]:
    rows = _table(spark, sf_dir, "mix_goals").collect()  # a list of parameters
    return [Goal(r.source_name, r.goal_share, r.max_repeats) for r in sorted(rows, key=lambda r: r.source_name)]


def _source() -> Column:
    return F.array(F.lower(F.trim("source")))


def _sources_and_language() -> Column:
    return F.array(F.lower(F.trim("source")), F.concat(F.lit("lang:"), "lang"))


def _overlapping_goals(spark: SparkSession, sf_dir: str) -> list[Goal]:
    """Half of the mixture by source, half by language: every document with both may serve either."""
    goals = [Goal(g.source, g.share / 2, g.max_repeats) for g in _goals(spark, sf_dir)]
    return goals + [Goal(f"lang:{x}", share, 2) for x, share in (("de", 0.15), ("en", 0.1), ("es", 0.15), ("fr", 0.1))]


def _mixed(sizes: DataFrame, sources: Column, goals: list[Goal]) -> DataFrame:
    return mix(sizes.where(F.col("source").isNotNull()), "doc_id", sources, "n_tokens", goals)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    sized = count_tokens(docs, "text", ["doc_id", "source"])
    return mix(sized, "doc_id", _source(), "n_tokens", _goals(spark, sf_dir)).withColumnRenamed("size", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p8_mixture(spark, sf_dir).withColumnRenamed("n_tokens", "size"), _goals(spark, sf_dir))


def p8_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(_sizes(spark, sf_dir, "source", "lang"), _sources_and_language(), _overlapping_goals(spark, sf_dir))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir, "source", "lang").where(F.col("source").isNotNull())
    plain, twofold = _goals(spark, sf_dir), _overlapping_goals(spark, sf_dir)
    one = mixing_faults(_mixed(sizes, _source(), plain), sizes, "doc_id", _source(), "n_tokens", plain)
    two = mixing_faults(_mixed(sizes, _sources_and_language(), twofold), sizes, "doc_id", _sources_and_language(), "n_tokens", twofold)
    return one.withColumn("goals", F.lit("sources")).unionByName(two.withColumn("goals", F.lit("sources and languages")))


_P8_FAULTS = """
SELECT *, CAST(0 AS BIGINT) AS over_repeats, CAST(0 AS BIGINT) AS of_others, CAST(0 AS BIGINT) AS short FROM (
  SELECT 'sources' AS goals, source_name FROM mix_goals
  UNION ALL SELECT 'sources and languages', source_name FROM mix_goals
  UNION ALL SELECT 'sources and languages', unnest(['lang:de', 'lang:en', 'lang:es', 'lang:fr'])
)
"""

# 9: template residue


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_table(spark, sf_dir, "documents"))


def p9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")
    mined = mine_templates(scanned.where("message IS NOT NULL").select("leaf", "message"))
    return classified_templates(mined).select("template", "verdict", "n_messages", F.col("n").alias("n_documents"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(residue(docs).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_ranked": p1_ranked,
        "p3_found": p3_found,
        "p3_counts": p3_counts,
        "p4_found": p4_found,
        "p4_removable": p4_removable,
        "p5_found": p5_found,
        "p5_rates": p5_rates,
        "p5_unverified": p5_unverified,
        "p7_packed": p7_packed,
        "p7_fill": p7_fill,
        "p7_faults": p7_faults,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p8_overlapping": p8_overlapping,
        "p8_faults": p8_faults,
        "p9_found": p9_found,
        "p9_kinds": p9_kinds,
        "p9_templates": p9_templates,
        "p9_kept": p9_kept,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT row_no FROM ({_P1})",
        "p1_ranked": _P1,
        "p3_found": f"SELECT mseq FROM ({_P3})",
        "p3_counts": _P3,
        "p4_found": _PIECES.format(which="low <> high"),
        "p4_removable": _PIECES.format(which="rec_id > low"),
        "p5_found": _P5,
        "p5_rates": _P5_RATES,
        "p7_faults": _P7_FAULTS,
        "p8_faults": _P8_FAULTS,
    }
