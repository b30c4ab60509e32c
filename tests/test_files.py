import gzip
import json
import warnings
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

import seqjoin.__main__ as command
from seqjoin import scratch
from seqjoin.config import Config, from_args, from_json
from seqjoin.operators.targets import prepare_targets
from seqjoin.plans.pipeline import run
from seqjoin.sources import readers, snappy, writers

TARGETS = "g0\tGTAGGATATCTCAGA\n\ng1\tTTTGTAGGATATC\n"


def text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def frames(*blocks):
    """A stream of packed and plain chunks, with one to be skipped."""
    out = snappy.HEAD
    for i, b in enumerate(blocks):
        body = int(snappy.checksums([b])[0]).to_bytes(4, "little") + b
        out += snappy.framed(b) if i % 2 == 0 else b"\x01" + len(body).to_bytes(3, "little") + body
    return out + b"\xfe\x03\x00\x00abc"


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(">r1 x\nATGC\n+\nFFFF\n@r2\n\n+\n\n@cut\nAT\n+\n")
    (tmp_path / "b.fastq").write_text("".join(f"@b{i}\n{'ATGC' * (i % 5)}\n+\n{'F' * 4 * (i % 5)}\n" for i in range(500)))
    got = {(r.name, r.seq) for r in readers.read_fastq(spark, str(tmp_path / "*.fastq")).collect()}
    assert got == {(">r1 x", "ATGC"), ("@r2", "")} | {(f"@b{i}", "ATGC" * (i % 5)) for i in range(500)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = readers.read_fastq(spark, str(tmp_path / "b.fastq"))
        assert {(r.name, r.seq) for r in split.collect()} == {x for x in got if x[0].startswith("@b")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_targets_in_every_form(spark, tmp_path):
    want = [("g0", "GTAGGATATCTCAGA"), ("g1", "TTTGTAGGATATC")]
    (tmp_path / "t.txt").write_text(TARGETS)
    (tmp_path / "t.txt.gz").write_bytes(gzip.compress(TARGETS.encode()))
    (tmp_path / "t.txt.sz").write_bytes(frames(TARGETS[:7].encode(), TARGETS[7:20].encode(), TARGETS[20:].encode()))
    for name in ("t.txt", "t.txt.gz", "t.txt.sz"):
        assert [tuple(r) for r in readers.read_targets(spark, str(tmp_path / name)).collect()] == want
    (tmp_path / "t.fasta").write_text(">g0 one\nGTAGGAT\r\nATCTCAGA\n>empty\n>g1\nTTTGTAGGATATC\n")
    assert [tuple(r) for r in readers.read_targets(spark, str(tmp_path / "t.fasta")).collect()] == [(">g0 one", want[0][1]), (">g1", want[1][1])]
    (tmp_path / "bad.txt").write_text("g0\tAT\textra\n")
    with pytest.raises(PySparkException):
        readers.read_targets(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(ValueError):
        list(snappy.blocks_of(b"\x02\x01\x00\x00a"))


def test_text_before_the_first_header_is_no_record(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk line\nACGT\n>a\nAC\nGT\n>b x\nTT")
    (tmp_path / "b.fasta").write_text(">>c\nGG\n")
    (tmp_path / "c.fasta").write_text("")
    (tmp_path / "d.fasta").write_text("".join(f">n{i}\n{'ACGT' * (i % 40)}\n" for i in range(1, 300)))
    got = sorted((r.name, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "[abc].fasta")).collect())
    assert got == [(">>c", "GG"), (">a", "ACGT"), (">b x", "TT")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        many = {(r.name, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "d.fasta")).collect()}
        assert many == {(f">n{i}", "ACGT" * (i % 40)) for i in range(1, 300) if i % 40}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", [97, 700, 5000])
def test_fastq_records_across_blocks(spark, tmp_path, block):
    """Records may begin and end anywhere, lines may be longer than blocks."""
    records = [(f"@r{i}", "ACGT" * (i * i % 61)) for i in range(60)] + [("@last", "A" * 400)]
    (tmp_path / "r.fastq").write_text("".join(f"{n}\n{s}\n+\n{'F' * len(s)}\r\n" for n, s in records) + "@cut\nAC\n+\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = readers.read_fastq(spark, str(tmp_path / "*.fastq"))
        assert sorted((r.name, r.seq) for r in got.collect()) == sorted(records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_framed_snappy_round_trip(spark, tmp_path):
    assert snappy.checksums([b"123456789", b"", b"a" * 70]).tolist()[0] == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) % 2**32
    rows = [f"g{i}\t{'ACGT' * (i % 700)}" for i in range(900)]
    writers.write_lines(spark.createDataFrame([(x,) for x in rows], "value string").repartition(3), str(tmp_path / "t.txt.sz"))
    got = readers.read_framed_snappy(spark, str(tmp_path / "t.txt.sz/part-*"))
    assert sorted(r.value for r in got.collect()) == sorted(rows)
    data = bytearray(frames(b"plain", b"text"))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(snappy.blocks_of(bytes(data)))
    with pytest.raises(ValueError):
        writers.write_lines(spark.range(1).selectExpr("'a' AS value"), "hdfs://x/t.sz")


def test_prepared_targets_come_back(spark, tmp_path):
    targets = prepare_targets(spark.createDataFrame([(i, f"t {i}", "ACGTN"[: i % 6]) for i in range(50)], "num long, name string, seq string"), rev=True)
    for suffix in ("", ".gz"):
        sequences, ids = writers.target_lines(targets)
        writers.write_lines(sequences, str(tmp_path / f"s.txt{suffix}"))
        writers.write_lines(ids, str(tmp_path / f"i.txt{suffix}"))
        back = readers.read_prepared_targets(spark, str(tmp_path / f"s.txt{suffix}"), str(tmp_path / f"i.txt{suffix}"))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, targets.collect()))


def test_a_whole_run(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TARGETS)
    (tmp_path / "r.fastq").write_text("".join(f"{n}\n{s}\n+\n!\n" for n, s in [("@b", "GTAGGATATC"), ("@a", "GTAGGATATC"), ("@no", "CCCCGGGGTT")]))
    cfg = Config(
        ReadFileName=str(tmp_path / "r.fastq"), GeneFileName=str(tmp_path / "t.txt"), ResultsFileName=str(tmp_path / "out.txt"), LogDir=str(tmp_path / "log"),
        Windows=(0, 5), WindowWidth=4, MaxReadLength=100,
    )
    run(spark, cfg)
    row = "GTAGGATATC\tGTAGGATATC\t{}\t0\t{}\t{}\t2\t@a;@b\n"
    assert text(tmp_path / "out.txt") == row.format(0, "g0", 15) + row.format(3, "g1", 13)
    assert text(tmp_path / "out.nonmatch.txt.fastq") == "@no#1\nCCCCGGGGTT\n+\n!!!!!!!!!!\n"
    assert text(tmp_path / "out_readstats.txt") == "@a;@b\tg0;g1;\n"
    assert text(tmp_path / "out_genestats.txt") == "g0\t1\t\ng1\t1\t\n"
    assert json.loads((tmp_path / "log/seqinfo.json").read_text()) == {"NumUnique": 2, "NumTotal": 3}
    assert [r.pos for r in readers.read_results(spark, str(tmp_path / "out.txt")).collect()] == [0, 3]
    assert from_json(tmp_path / "log/config.json") == cfg
    assert text(tmp_path / "log/reads_sorted.txt").splitlines()[1] == "GTAGGATATC\t2\t@a;@b"
    assert "3 reads used (2 distinct), 0 skipped" in (tmp_path / "log/run.log").read_text()
    with pytest.raises(ValueError, match="usable window"):
        run(spark, replace(cfg, WindowWidth=50))


def test_commands(spark, tmp_path):
    """Generate, prepare with reverse complements, then match against the stored targets."""
    command.generate(spark, ["--NumRead=20", "-ReadLen=40", "--NumGene=40", "--GeneLen=200", f"--Dir={tmp_path}"])
    (tmp_path / "g.txt").write_text(text(tmp_path / "genes.txt"))
    command.prepare(spark, str(tmp_path / "g.txt"), True)
    cfg = Config(
        ReadFileName=str(tmp_path / "reads.fastq"), GeneFileName=str(tmp_path / "targets_g.txt"), GeneIdFileName=str(tmp_path / "ids_g.txt"),
        ResultsFileName=str(tmp_path / "out.txt"), Windows=(0, 20), WindowWidth=15, MaxReadLength=100,
    )
    found = {(r.names, r.target, r.pos) for r in run(spark, cfg).results.collect()}
    assert {(f"read_{i % 10}", f"target_{i}", i % 10) for i in range(20)} <= found
    path = scratch.shared_dir(spark).removeprefix("file://")
    assert any(Path(path).rglob("*.parquet"))
    scratch.release(spark)
    assert not any(Path(path).rglob("*.parquet"))

def test_target_export(spark):
    rows = spark.createDataFrame([("g\t1", "ATN"), ("g2", "C")], "name string, seq string").coalesce(1)
    sequences, ids = writers.target_lines(prepare_targets(rows))
    assert [r.value for r in sequences.collect()] == ["ATX", "C"]
    assert [r.value for r in ids.collect()] == ["00000000000\tg 1\t3", "00000000001\tg2\t1"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"Windows": [0, 20], "WindowWidth": 15, "MMTol": 2, "PMatch": 0, "Unknown": 1, "MaxReadLength": 50}))
    cfg = from_args([f"-ConfigFileName={tmp_path / 'c.json'}", "--MMTol=0", "--WindowWidth=12", "-NoCleanTemp"])
    assert (cfg.Windows, cfg.WindowWidth, cfg.MMTol, cfg.PMatch, cfg.NoCleanTemp, cfg.MaxMatches) == ((0, 20), 12, 2, 1.0, True, 1_000_000)
    assert from_args(["--Windows=3,4"]).Windows == (3, 4)
    with pytest.raises(ValueError, match="missing"):
        Config().check()
    for bad in ({"PMatch": 2.0}, {"MaxMatches": 0}, {"Windows": (-1,)}):
        with pytest.raises(ValueError):
            Config(**{"Windows": (0,), "WindowWidth": 4, "MaxReadLength": 9, **bad}).check(files=False)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        Config(ReadFileName="r.txt", GeneFileName="g", Windows=(0,), WindowWidth=4, MaxReadLength=9).check()
    assert len(said) == 1
