"""Small runs whose every output line, in order, is known.  Fixed values: the targets, reads and lines below."""

import pytest

from seqjoin.config import Config, from_args
from seqjoin.plans.pipeline import run
from seqjoin.operators.targets import prepare_targets
from seqjoin.sources import readers, writers

SHORT = """gene0 ATCAGACCGATCGTTACGAT
gene1 GCTATCGATCGATTCAGCAT
gene2 GGCTATCGACTATCGGACAT
gene3 TTTGTGGATCGTAGGATATC
gene4 GGCTACGATTCAGCTTACAC
gene5 CGGCTTACGGCTCGACTGGC
gene6 TTAGCACTACTACCTACCAT
gene7 CCGATCTACCAGTTCAGCCA
gene8 CCGATCTACGGACTTACAGC
gene9 ACGACTACTTAGGCTTACCA"""
LONG = """gene1 AGGCTTCACGTAGGATATCATCACG
gene2 ACAAACTAGCGATCTTAGGCATCTT
gene3 GTAGGATATCTCAGAGCTACAGCGA
gene4 TTCAGCGGGATCTATAGCGCGACAT
gene5 TTAGCGAGCGATTCTAGCGACTTAC
gene6 CGAGCTCGGCTTACGGGATTTACGC
gene7 TTAGGCGACATCAGGCATCTACTAG
gene8 TTCAGCATCTACGGGATCTACAGGC"""
MANY = LONG.replace("CGAGCTCGGCTTACGGGATTTACGC", "CGGCTTACGGTTAGTTCAGCCAACC").replace("TTAGGCGACATCAGGCATCTACTAG", "GTAGGATATCCGGCTTACGGTTTTT").replace(
    "TTCAGCATCTACGGGATCTACAGGC", "GTAGGATATCGTAGGATATCCAGGC"
)
BOTH = """gene0 ATCAGAGTAGGATATCCGAT
gene1 GCTAGTAGGATATCCAGCAT
gene2 GGCTAGTAGGATATCGACAT
gene3 TTGTAGGATATCAGGATATC
gene4 GGCTACGAGTAGGATATCAC
gene5 CGTAGGATATCTCGACTGGC
gene6 TTAGCAGTAGGATATCCCAT
gene7 CCGATGTAGGATATCAGCCA
gene8 GTAGGATATCGACTTACAGC
gene9 ACGGTAGGATATCCTTACCA"""
G, C, A = "GTAGGATATC", "CGGCTTACGG", "AGTTCAGCCA"
CASES = {
    "exact": (
        SHORT, False, [(">read1_matching", G), (">read2_matching", C), (">read3_matching", A), (">read4_nonmatching", "GTACGCATCC"), (">read5_nonmatching", "TTATTATGCG"), (">read6_nonmatching", "GCCGCTACGA")],
        [(A, 10, "gene7", 20, 1, ">read3_matching"), (C, 0, "gene5", 20, 1, ">read2_matching"), (G, 10, "gene3", 20, 1, ">read1_matching")],
        [(">read6_nonmatching#1", "GCCGCTACGA"), (">read4_nonmatching#1", "GTACGCATCC"), (">read5_nonmatching#1", "TTATTATGCG")],
    ),
    "copies": (
        SHORT, False, [(">read1_matching", G), (">read2_matching", C), (">read3_matching", A), (">read4_nonmatching", "GTACGCATCC"), (">read5_copy", G), (">read6_copy", "GTACGCATCC")],
        [(A, 10, "gene7", 20, 1, ">read3_matching"), (C, 0, "gene5", 20, 1, ">read2_matching"), (G, 10, "gene3", 20, 2, ">read1_matching;>read5_copy")],
        [(">read4_nonmatching;>read6_copy#2", "GTACGCATCC")],
    ),
    "several targets": (
        LONG, False, [(">read1_match2", G), (">read2_match1", C), (">read3_match0", A)],
        [(C, 6, "gene6", 25, 1, ">read2_match1"), (G, 0, "gene3", 25, 1, ">read1_match2"), (G, 9, "gene1", 25, 1, ">read1_match2")],
        [(">read3_match0#1", A)],
    ),
    "twice in a target": (
        MANY, False, [(">read1", G), (">read2", C), (">read3", A)],
        [(A, 12, "gene6", 25, 1, ">read3"), (C, 0, "gene6", 25, 1, ">read2"), (C, 10, "gene7", 25, 1, ">read2")]
        + [(G, p, f"gene{g}", 25, 1, ">read1") for p, g in ((0, 3), (0, 7), (0, 8), (10, 8), (9, 1))],
        [],
    ),
    "reverse complements": (
        BOTH, True, [(">read1", G), (">read2", C), (">read3", A), (">read4", "GTACGCATCC"), (">read5", "CTACTTAGGC"), (">read6", "TGGTAAGGAT")],
        [(G, p, f"gene{g}", 20, 1, ">read1") for p, g in ((0, 8), (1, 5), (2, 3), (3, 9), (4, 1), (5, 2), (5, 7), (6, 0), (6, 6), (8, 4))] + [("TGGTAAGGAT", 0, "gene9_r", 20, 1, ">read6")],
        [(">read3#1", A), (">read2#1", C), (">read5#1", "CTACTTAGGC"), (">read4#1", "GTACGCATCC")],
    ),
}


def text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


@pytest.mark.parametrize("flags", [False, True])
@pytest.mark.parametrize("name", CASES)
def test_run(spark, tmp_path, name, flags):
    targets, rev, reads, found, missing = CASES[name]
    if flags and name != "several targets":
        pytest.skip("one case is also run from flags")
    (tmp_path / "genes.txt").write_text("".join(x.replace(" ", "\t") + "\n" for x in targets.split("\n")))
    (tmp_path / "reads.fastq").write_text("".join(f"{n}\n{s}\n+\n{'F' * len(s)}\n" for n, s in reads))
    given = {
        "ReadFileName": str(tmp_path / "reads.fastq"), "GeneFileName": str(tmp_path / "genes.txt"), "ResultsFileName": str(tmp_path / "result.txt"), "Windows": (0, 5), "WindowWidth": 4,
        "BloomSize": 4_000_000, "NumHash": 20, "PMatch": 1.0, "MinDinuc": 1, "MaxMatches": 1000, "MaxConfirmProcs": 5, "MaxReadLength": 300, "MatchMode": "best", "MMTol": 1,
    }
    cfg = from_args([f"-{k}={'0,5' if k == 'Windows' else v}" for k, v in given.items()]) if flags else Config(**given)
    run(spark, cfg, rev)
    assert text(tmp_path / "result.txt") == "".join(f"{s}\t{s}\t{p}\t0\t{t}\t{n}\t{c}\t{names}\n" for s, p, t, n, c, names in found)
    assert text(tmp_path / "result.nonmatch.txt.fastq") == "".join(f"{h}\n{s}\n+\n{'!' * len(s)}\n" for h, s in missing)


@pytest.mark.parametrize("rev", [False, True])
@pytest.mark.parametrize("suffix", [".fasta", ".txt", ".txt.gz", ".txt.sz"])
def test_preparation(spark, tmp_path, suffix, rev):
    import gzip

    from seqjoin.sources import snappy

    mark = ">" * (suffix == ".fasta")
    body = ">gene1\nATACGATC\nTACGATCA\n>gene2\nTTAATTAATTAA\n>gene3\nAT\nTA\nGG\nCC\n" if mark else "gene1\tATACGATCTACGATCA\ngene2\tTTAATTAATTAA\ngene3\tATTAGGCC\n"
    data = body.encode()
    (tmp_path / f"g{suffix}").write_bytes(gzip.compress(data) if suffix.endswith("gz") else snappy.HEAD + snappy.framed(data) if suffix.endswith("sz") else data)
    sequences, ids = writers.target_lines(prepare_targets(readers.read_targets(spark, str(tmp_path / f"g{suffix}")), rev))
    plain = [("gene1", "ATACGATCTACGATCA", "TGATCGTAGATCGTAT"), ("gene2", "TTAATTAATTAA", "TTAATTAATTAA"), ("gene3", "ATTAGGCC", "GGCCTAAT")]
    rows = [x for n, s, r in plain for x in ([(mark + n, s), (f"{mark}{n}_r", r)] if rev else [(mark + n, s)])]
    assert [r.value for r in sequences.collect()] == [s for _, s in rows]
    assert [r.value for r in ids.collect()] == [f"{i:011d}\t{n}\t{len(s)}" for i, (n, s) in enumerate(rows)]
