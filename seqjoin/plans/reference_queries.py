"""One query per operator over the project's tables, and the SQL of each.

Reads are read_in_seq; targets are the distinct target stretches of results, numbered by
their smallest row number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqjoin.config import Config
from seqjoin.functions.bases import dinucleotides, first_word, hamming, mask, mismatch_budget, reverse_complement, shortened_name, truncated
from seqjoin.functions.sketches import bloom_parameters
from seqjoin.operators import match as m
from seqjoin.operators import reads as r
from seqjoin.operators import report
from seqjoin.operators.targets import prepare_targets, target_windows
from seqjoin.plans import pipeline, synthetic
from seqjoin.scratch import materialize, new_path
from seqjoin.sources import readers, writers

CFG = Config(Windows=(0, 20, 40), WindowWidth=20, PMatch=0.9, MinDinuc=5, MinReadLength=30, MaxReadLength=100, MMTol=1)
EXACT = replace(CFG, PMatch=1.0, MMTol=0)
BEST2 = replace(CFG, MaxMatches=2)
FIRST2 = replace(CFG, MaxMatches=2, MatchMode="first")


def raw_reads(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/read_in_seq.parquet").select(F.col("read_name").alias("name"), "seq")


def raw_targets(spark: SparkSession, sf: str) -> DataFrame:
    found = spark.read.parquet(f"{sf}/results.parquet").where(F.col("target_sub").isNotNull())
    found = found.groupBy(F.col("target_sub").alias("seq")).agg(F.min("row_no").alias("num"))
    return found.select("num", F.concat(F.lit("sub_"), F.col("num").cast("string")).alias("name"), "seq")


def targets(spark: SparkSession, sf: str, rev: bool = False) -> DataFrame:
    return prepare_targets(raw_targets(spark, sf), rev)


def unique(spark: SparkSession, sf: str) -> DataFrame:
    return r.unique_reads(r.prepare_reads(raw_reads(spark, sf), CFG))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return r.read_windows(unique(spark, sf), CFG)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialize(unique(spark, sf), "reads")
    return m.candidates(r.read_windows(reads, CFG), target_windows(targets(spark, sf), CFG.WindowWidth), m.windows_at_most(reads, CFG))


def fits(spark: SparkSession, sf: str, tail: bool = False) -> DataFrame:
    return m.fitting(pairs(spark, sf).select("seq", "num", "pos").distinct(), targets(spark, sf), CFG.MaxReadLength, tail)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return m.within_budget(fits(spark, sf), CFG.PMatch)


def hits_per_window(spark: SparkSession, sf: str) -> DataFrame:
    """A match of several windows stands here as often."""
    return m.within_budget(m.fitting(pairs(spark, sf), targets(spark, sf), CFG.MaxReadLength), CFG.PMatch)


def screened(spark: SparkSession, sf: str) -> DataFrame:
    keys = windows(spark, sf)
    return m.screen(target_windows(targets(spark, sf), CFG.WindowWidth), keys).join(keys.select("key").distinct(), "key", "left_semi")


def capped(spark: SparkSession, sf: str, cfg: Config) -> DataFrame:
    found = m.within_budget(fits(spark, sf, True), cfg.PMatch)
    return m.capped(m.seeding_windows(found, cfg), cfg).select("win", "key", "seq", "num", "pos", "nmiss")


def best(spark: SparkSession, sf: str) -> DataFrame:
    return m.best_matches(materialize(hits(spark, sf), "matches").select("seq", "sub", "pos", "nmiss", "num"), CFG.MMTol)


def matched(spark: SparkSession, sf: str, cfg: Config = CFG, rev: bool = False) -> pipeline.Matched:
    return pipeline.match(raw_reads(spark, sf), materialize(targets(spark, sf, rev), "targets"), cfg)


def _masked(spark: SparkSession, sf: str, **columns) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/read_in_seq.parquet")
    return rows.select("read_no", *(c.alias(n) for n, c in columns.items()))


# Files: the tables written in a format and read back


def _written(spark: SparkSession, lines: DataFrame, suffix: str) -> str:
    path = f"{new_path(spark, 'files')}{suffix}"
    writers.write_lines(lines, path)
    return path


def scan_fastq(spark: SparkSession, sf: str) -> DataFrame:
    reads = raw_reads(spark, sf).where("name IS NOT NULL AND seq IS NOT NULL")
    return readers.read_fastq(spark, _written(spark, writers.fastq_lines(reads), ".fastq"))


def scan_fasta(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_fasta(spark, _written(spark, writers.fasta_lines(raw_targets(spark, sf)), ".fasta"))


def _target_text(spark: SparkSession, sf: str) -> DataFrame:
    return raw_targets(spark, sf).select(F.concat_ws("\t", "name", "seq").alias("value"))


def scan_targets(spark: SparkSession, sf: str, suffix: str) -> DataFrame:
    path = _written(spark, _target_text(spark, sf), suffix)
    return readers.read_targets(spark, f"{path}/part-*{suffix.removeprefix('.txt')}" if suffix.endswith("z") else path, "text")


def scan_prepared_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared anew from the export, so numbered by place: by rank of the first number."""
    sequences, ids = writers.target_lines(prepare_targets(raw_targets(spark, sf).orderBy("num").drop("num")))
    return readers.read_prepared_targets(spark, _written(spark, sequences, ".txt"), _written(spark, ids, ".ids.txt.gz"))


def scan_results(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_results(spark, _written(spark, writers.result_lines(matched(spark, sf).results), ".txt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    seq = F.col
    return {
        "mask_bases": lambda s, d: _masked(s, d, masked=mask(seq("seq"))),
        "reverse_complement": lambda s, d: _masked(s, d, rc=reverse_complement(mask(seq("seq")))),
        "rev_expand": lambda s, d: targets(s, d, True).select("num", "name", "seq", "len"),
        "prepare_targets": lambda s, d: targets(s, d),
        "min_length": lambda s, d: r.prepare_reads(raw_reads(s, d), CFG),
        "truncate_reads": lambda s, d: _masked(s, d, cut=truncated(mask(seq("seq")), 100)),
        "name_truncate": lambda s, d: _masked(s, d, name=shortened_name(seq("read_name"))),
        "unique_reads": unique,
        "seq_info": lambda s, d: r.seq_info(unique(s, d)),
        "read_windows": windows,
        "window_counts": lambda s, d: r.window_counts(windows(s, d)),
        "dinuc_count": lambda s, d: _masked(s, d, pairs=dinucleotides(seq("seq"))),
        "complexity_filter": lambda s, d: _masked(s, d, seq=seq("seq")).where(dinucleotides(seq("seq")) >= 12).select("read_no"),
        "target_kmers": lambda s, d: target_windows(targets(s, d), CFG.WindowWidth),
        "screen_semi": lambda s, d: screened(s, d).select("num", "p", "key"),
        "seed_join": pairs,
        "fit_filter": fits,
        "hamming": lambda s, d: fits(s, d).select("seq", "num", "pos", hamming(seq("seq"), seq("sub")).alias("nmiss")),
        "mismatch_budget": lambda s, d: unique(s, d).select("seq", mismatch_budget(F.length("seq"), CFG.PMatch).alias("budget")),
        "confirm_best_cap": lambda s, d: capped(s, d, BEST2),
        "confirm_first_cap": lambda s, d: capped(s, d, FIRST2),
        "combine_distinct": lambda s, d: m.combine(hits_per_window(s, d)),
        "best_within_tol": best,
        "join_target_names": lambda s, d: report.join_target_names(best(s, d), targets(s, d)),
        "join_read_names": lambda s, d: report.join_read_names(best(s, d), unique(s, d)),
        "results_exact": lambda s, d: matched(s, d, EXACT).results,
        "results_mismatch": lambda s, d: matched(s, d).results,
        "results_revcomp": lambda s, d: matched(s, d, CFG, True).results,
        "results_capped": lambda s, d: matched(s, d, BEST2).results,
        "non_matches": lambda s, d: matched(s, d).non_matches,
        "non_match_fastq": lambda s, d: writers.non_match_lines(matched(s, d).non_matches),
        "result_lines": lambda s, d: writers.result_lines(matched(s, d).results),
        "target_id_lines": lambda s, d: writers.target_lines(targets(s, d, True))[1],
        "read_stat_lines": lambda s, d: writers.read_stat_lines(matched(s, d).read_stats),
        "target_stat_lines": lambda s, d: writers.target_stat_lines(matched(s, d).target_stats),
        "read_stats": lambda s, d: matched(s, d).read_stats,
        "target_stats": lambda s, d: matched(s, d).target_stats,
        "first_words": lambda s, d: _masked(s, d, word=first_word(seq("read_name"))),
        "unique_read_lines": lambda s, d: writers.unique_read_lines(unique(s, d)),
        "scan_fastq": scan_fastq,
        "scan_fasta": scan_fasta,
        "scan_text_targets": lambda s, d: scan_targets(s, d, ".txt"),
        "scan_gzip_targets": lambda s, d: scan_targets(s, d, ".txt.gz"),
        "scan_snappy_targets": lambda s, d: scan_targets(s, d, ".txt.sz"),
        "scan_prepared_targets": scan_prepared_targets,
        "scan_results": scan_results,
        "bloom_params": lambda s, d: s.createDataFrame([(n, p, *bloom_parameters(n, p)) for n, p in _BLOOMS], "items long, rate double, bits long, hashes long"),
        "synth_reads": lambda s, d: synthetic.generate_reads(s, 1000, 100),
        "synth_targets": lambda s, d: synthetic.generate_targets(s, 1000, 500),
    }


_BLOOMS = [(100_000_000, 1e-6), (1_000_000, 0.01), (1000, 0.001)]

_BASE = """
WITH prepared AS (
  SELECT left(regexp_replace(seq, '[^ATGC]', 'X', 'g'), 100) AS seq,
    CASE WHEN length(read_name) > 1000 THEN left(read_name, 995) || '...' ELSE read_name END AS name
  FROM read_in_seq WHERE length(seq) >= 30
), listed AS (
  SELECT seq, count(*) AS count, coalesce(string_agg(name, ';' ORDER BY name), '') AS names FROM prepared GROUP BY seq
), reads AS (
  SELECT seq, count, CASE WHEN length(names) > 1000 THEN left(names, 996) || '...' ELSE names END AS names FROM listed
), cut AS (
  SELECT win, q1, substr(seq, q1 + 1, 20) AS key, seq FROM reads, (VALUES (0, 0), (1, 20), (2, 40)) w(win, q1) WHERE q1 + 20 <= length(seq)
), windows AS (
  SELECT * FROM cut WHERE len(list_distinct([substr(key, i, 2) for i in range(1, length(key))])) >= 5
), targets AS (
  SELECT num, 'sub_' || num AS name, regexp_replace(target_sub, '[^ATGC]', 'X', 'g') AS seq, CAST(length(target_sub) AS INTEGER) AS len
  FROM (SELECT target_sub, min(row_no) AS num FROM results WHERE target_sub IS NOT NULL GROUP BY target_sub)
), both_strands AS (
  SELECT num * 2 AS num, name, seq, len FROM targets
  UNION ALL SELECT num * 2 + 1, name || '_r', translate(reverse(seq), 'ATGC', 'TACG'), len FROM targets
), kmers AS (
  SELECT num, CAST(p AS INTEGER) AS p, substr(seq, CAST(p AS INTEGER) + 1, 20) AS key
  FROM (SELECT num, seq, unnest(range(length(seq) - 19)) AS p FROM {strands} WHERE length(seq) >= 20)
), pairs AS (
  SELECT win, w.key, seq, num, p - q1 AS pos FROM windows w JOIN kmers k ON w.key = k.key AND p >= q1
), fits AS (
  SELECT c.seq, c.num, c.pos, substr(t.seq, pos + 1, length(c.seq)) AS sub, substr(t.seq, pos + 1, 100) AS tail
  FROM (SELECT DISTINCT seq, num, pos FROM pairs) c JOIN {strands} t USING (num) WHERE pos + length(c.seq) <= length(t.seq)
), hits AS (
  SELECT seq, sub, pos, CAST(hamming(seq, sub) AS INTEGER) AS nmiss, num, tail FROM fits
  WHERE hamming(seq, sub) <= trunc((1.0::DOUBLE - {pmatch}::DOUBLE) * length(seq))
), seeded AS (
  SELECT h.*, p.win, p.key, 20 * p.win AS q FROM hits h JOIN pairs p USING (seq, num, pos)
), best AS (
  SELECT seq, sub, pos, nmiss, num FROM {hits} QUALIFY nmiss <= min(nmiss) OVER (PARTITION BY seq) + {tol}
), named AS (
  SELECT b.seq, b.sub, b.pos, b.nmiss, t.name AS target, t.len AS target_len, r.count AS copies, r.names
  FROM best b JOIN {strands} t USING (num) JOIN reads r ON r.seq = b.seq
)
"""


def _sql(query: str, strands: str = "targets", pmatch: float = 0.9, tol: int = 1, hits: str = "hits") -> str:
    return _BASE.format(strands=strands, pmatch=pmatch, tol=tol, hits=hits) + query


_RANKED = "SELECT win, key, seq, num, pos, nmiss, sub FROM seeded QUALIFY row_number() OVER (PARTITION BY win, key ORDER BY {order}) <= {most}"
_BEST2 = _RANKED.format(order="nmiss, num, pos, seq", most=2)
_FIRST2 = _RANKED.format(
    order="left(tail, q), substr(tail, q + 21), num, CAST(pos + q AS VARCHAR), left(seq, q), substr(seq, q + 21)", most=3
)
_RAW_TARGETS = "SELECT min(row_no) AS num, 'sub_' || min(row_no) AS name, target_sub AS seq FROM results WHERE target_sub IS NOT NULL GROUP BY target_sub"
_MASKED = "regexp_replace(seq, '[^ATGC]', 'X', 'g')"
_PAIRS = f"CASE WHEN length(seq) >= 2 THEN CAST(len(list_distinct([substr({_MASKED}, i, 2) for i in range(1, length(seq))])) AS INTEGER) WHEN seq IS NOT NULL THEN 0 END"
_MISSING = "SELECT seq, count, names FROM reads WHERE seq NOT IN (SELECT seq FROM named)"


def oracle_sql() -> dict[str, str]:
    return {
        "mask_bases": f"SELECT read_no, {_MASKED} AS masked FROM read_in_seq",
        "reverse_complement": f"SELECT read_no, translate(reverse({_MASKED}), 'ATGC', 'TACG') AS rc FROM read_in_seq",
        "rev_expand": _sql("SELECT num, name, seq, len FROM both_strands"),
        "prepare_targets": _sql("SELECT num, name, seq, len FROM targets"),
        "min_length": _sql("SELECT seq, name FROM prepared"),
        "truncate_reads": f"SELECT read_no, left({_MASKED}, 100) AS cut FROM read_in_seq",
        "name_truncate": "SELECT read_no, CASE WHEN length(read_name) > 1000 THEN left(read_name, 995) || '...' ELSE read_name END AS name FROM read_in_seq",
        "unique_reads": _sql("SELECT seq, count, names FROM reads"),
        "seq_info": _sql('SELECT count(*) AS "NumUnique", CAST(sum(count) AS BIGINT) AS "NumTotal" FROM reads'),
        "read_windows": _sql("SELECT win, q1, key, seq FROM windows"),
        "window_counts": _sql("SELECT q1, count(*) AS n_reads FROM windows GROUP BY q1"),
        "dinuc_count": f"SELECT read_no, {_PAIRS} AS pairs FROM read_in_seq",
        "complexity_filter": f"SELECT read_no FROM read_in_seq WHERE {_PAIRS} >= 12",
        "target_kmers": _sql("SELECT num, p, key FROM kmers"),
        "screen_semi": _sql("SELECT num, p, key FROM kmers WHERE key IN (SELECT key FROM windows)"),
        "seed_join": _sql("SELECT win, key, seq, num, pos FROM pairs"),
        "fit_filter": _sql("SELECT seq, num, pos, sub FROM fits"),
        "hamming": _sql("SELECT seq, num, pos, CAST(hamming(seq, sub) AS INTEGER) AS nmiss FROM fits"),
        "mismatch_budget": _sql("SELECT seq, CAST(trunc((1.0::DOUBLE - 0.9::DOUBLE) * length(seq)) AS INTEGER) AS budget FROM reads"),
        "confirm_best_cap": _sql(f"SELECT win, key, seq, num, pos, nmiss FROM ({_BEST2})"),
        "confirm_first_cap": _sql(f"SELECT win, key, seq, num, pos, nmiss FROM ({_FIRST2})"),
        "combine_distinct": _sql("SELECT seq, sub, pos, nmiss, num FROM hits"),
        "best_within_tol": _sql("SELECT seq, sub, pos, nmiss, num FROM best"),
        "join_target_names": _sql("SELECT b.seq, sub, pos, nmiss, name AS target, len AS target_len FROM best b JOIN targets USING (num)"),
        "join_read_names": _sql("SELECT b.seq, sub, pos, nmiss, num, count AS copies, names FROM best b JOIN reads r ON r.seq = b.seq"),
        "results_exact": _sql("SELECT * FROM named", pmatch=1.0, tol=0),
        "results_mismatch": _sql("SELECT * FROM named"),
        "results_revcomp": _sql("SELECT * FROM named", strands="both_strands"),
        "results_capped": _sql("SELECT * FROM named", hits=f"(SELECT DISTINCT seq, sub, pos, nmiss, num FROM ({_BEST2}))"),
        "non_matches": _sql(_MISSING),
        "non_match_fastq": _sql(f"SELECT concat(names, '#', count, chr(10), seq, chr(10), '+', chr(10), repeat('!', length(seq))) AS value FROM ({_MISSING})"),
        "result_lines": _sql("SELECT concat_ws(chr(9), seq, sub, pos, nmiss, replace(target, chr(9), ' '), target_len, copies, replace(names, chr(9), ' ')) AS value FROM named"),
        "target_id_lines": _sql("SELECT concat(lpad(CAST(num AS VARCHAR), 11, '0'), chr(9), name, chr(9), len) AS value FROM both_strands"),
        "read_stat_lines": _sql("SELECT concat(replace(names, chr(9), ' '), chr(9), string_agg(DISTINCT target, ';' ORDER BY target), ';') AS value FROM named GROUP BY seq, names"),
        "target_stat_lines": _sql("SELECT concat(target, chr(9), count(*), chr(9)) AS value FROM named GROUP BY target"),
        "read_stats": _sql("SELECT seq, names, string_agg(DISTINCT target, ';' ORDER BY target) AS targets FROM named GROUP BY seq, names"),
        "target_stats": _sql("SELECT target, count(*) AS n FROM named GROUP BY target"),
        "first_words": "SELECT read_no, regexp_extract(read_name, '^\\s*(\\S*)', 1) AS word FROM read_in_seq",
        "unique_read_lines": _sql("SELECT concat_ws(chr(9), seq, count, replace(names, chr(9), ' ')) AS value FROM reads"),
        "scan_fastq": "SELECT read_name AS name, regexp_replace(seq, chr(13) || '$', '') AS seq FROM read_in_seq WHERE read_name IS NOT NULL AND seq IS NOT NULL",
        "scan_fasta": f"SELECT '>' || name AS name, seq FROM ({_RAW_TARGETS})",
        "scan_text_targets": f"SELECT name, seq FROM ({_RAW_TARGETS})",
        "scan_gzip_targets": f"SELECT name, seq FROM ({_RAW_TARGETS})",
        "scan_snappy_targets": f"SELECT name, seq FROM ({_RAW_TARGETS})",
        "scan_prepared_targets": _sql("SELECT row_number() OVER (ORDER BY num) - 1 AS num, name, seq, len FROM targets"),
        "scan_results": _sql("SELECT seq, sub, pos, nmiss, replace(target, chr(9), ' ') AS target, target_len, copies, replace(names, chr(9), ' ') AS names FROM named"),
        "bloom_params": """
SELECT items, rate, bits, CAST(ceil(ln(2) * bits / items) AS BIGINT) AS hashes
FROM (SELECT items, rate, CAST(ceil(-items * ln(rate) / (ln(2) * ln(2))) AS BIGINT) AS bits
  FROM (VALUES (100000000::BIGINT, 1e-6::DOUBLE), (1000000, 0.01), (1000, 0.001)) v(items, rate))""",
        "synth_reads": f"SELECT 'read_' || id AS name, {_blocks('read', 'id', 100)} AS seq FROM range(1000) t(id)",
        "synth_targets": _SYNTH_TARGETS,
    }


def _blocks(seed: str, number: str, length: int) -> str:
    parts = ", ".join(f"md5('{seed}:' || {number} || ':{i}')" for i in range(-(-length // 32)))
    return f"left(translate(concat({parts}), '0123456789abcdef', 'ATGCATGCATGCATGC'), {length})"


_SYNTH_TARGETS = f"""
SELECT num, 'target_' || num AS name,
  CASE WHEN num < 500 THEN left(concat(left(text, CAST(num % 10 AS INTEGER)), {_blocks("read", "(num % 10)", 100)}, substr(text, CAST(num % 10 AS INTEGER) + 101)), 500) ELSE text END AS seq
FROM (SELECT id AS num, {_blocks("target", "id", 500)} AS text FROM range(1000) t(id))
"""
