import gzip
import os

import duckdb
import pytest

from tests.test_operators import RC, make_reads, make_whitelist, plain_nanopore, plain_words, whitelist_csv
from tidewell import cli
from tidewell.operators import whitelist
from tidewell.plans.pipelines import run_count, run_illumina
from tidewell.plans.registry import ORACLE_SQL, QUERIES, _lanes
from tidewell.sources.bam import bam_bytes, register
from tidewell.streaming.reads import assign_stream, dedup_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    answer = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    pick = lambda r: tuple(repr(r[c]) for c in sorted(names))
    assert sorted(map(pick, rows)) == sorted(pick(dict(zip(names, r, strict=True))) for r in answer.fetchall())


def fasta(path):
    text = "".join(gzip.open(os.path.join(path, f), "rt").read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    lines = text.splitlines()
    return sorted(zip(lines[::2], lines[1::2], strict=True))


def fastq(path, reads):
    with gzip.open(path, "wt") as f:
        for n, s in reads:
            f.write(f"@{n} more\twords\n{s}\n+\n{'@' * len(s)}\n")


def rendered(cell):
    return "".join("ACGT"[cell >> 2 * i & 3] for i in reversed(range(16)))


def test_nanopore_run(spark, tmp_path):
    table = make_whitelist()
    reads = [(n, s) for n, s in make_reads(table, 60)]
    fastq(tmp_path / "r.fq.gz", reads)
    argv = ["barcode", "--nanopore", "--r1", str(tmp_path / "r.fq.gz"), "--whitelist", whitelist_csv(tmp_path, table), "-o", str(tmp_path / "out"), "--one-file"]
    assert cli.main(argv, spark) == 0
    words, passed, failed = plain_words(table), [], []
    for n, s in reads:
        status, cell, umi, cdna, polya = plain_nanopore(s, words)
        if status == "matched":
            turn = (lambda x: x) if polya else RC
            passed.append((f">{n}_{rendered(cell)}_{turn(umi)}", turn(cdna)))
        else:
            failed.append((f">{n}", s))
    assert fasta(tmp_path / "out/passed.bcd.nanopore.fa.gz") == sorted(passed)
    assert fasta(tmp_path / "out/failed.bcd.nanopore.fa.gz") == sorted(failed)


def test_illumina_run(spark, tmp_path):
    table = make_whitelist()
    row, umi = table[3], "ACGTACGTACGT"
    r1 = RC(row[3]) + "ATG" + RC(row[2]) + "GAG" + RC(row[1]) + "TCGAG" + RC(row[0]) + RC(umi)
    fastq(tmp_path / "1.fq.gz", [("a", r1), ("b", "ACGT" * 20), ("c", r1 + "N" + r1)])
    fastq(tmp_path / "2.fq.gz", [("a", "TTTT"), ("b", "CC"), ("c", "GG")])
    wl = whitelist_csv(tmp_path, table)
    counts = run_illumina(spark, str(tmp_path / "1.fq.gz"), str(tmp_path / "2.fq.gz"), wl, str(tmp_path / "o"))
    assert counts == {"total": 3, "matched": 1, "small": 0, "no_regex": 1, "multi": 1, "ambiguous": 0, "mismatch": 0}
    cell = sum(3 * 96**i for i in range(4))
    assert fasta(tmp_path / "o/read.bcd.illumina.fa.gz") == [(f">a_{rendered(cell)}_{umi}", "TTTT")]
    assert cli.main(["barcode", "--r1", "x", "--whitelist", "y", "-o", "z"], spark) == 2
    fastq(tmp_path / "2.fq.gz", [("a", "TTTT")])
    with pytest.raises(Exception, match="different numbers"):
        run_illumina(spark, str(tmp_path / "1.fq.gz"), str(tmp_path / "2.fq.gz"), wl, str(tmp_path / "o2"))


def test_several_lanes(spark, tmp_path):
    """Reads of several files pair within their lanes; another number of files is an error."""
    table = make_whitelist()
    row = table[2]
    r1 = RC(row[3]) + "ATG" + RC(row[2]) + "GAG" + RC(row[1]) + "TCGAG" + RC(row[0])
    for side in ("1", "2"):
        (tmp_path / side).mkdir()
    for lane in "ab":
        umis = ["ACGTACGTAC" + lane.replace("a", "AA").replace("b", "CC"), "TTTTTTTTTTTT"]
        fastq(tmp_path / f"1/{lane}_R1.fq.gz", [(f"{lane}{i}", r1 + RC(u)) for i, u in enumerate(umis)] + [(f"{lane}_2", r1 + RC(umis[0]))])
        fastq(tmp_path / f"2/{lane}_R2.fq.gz", [("x", lane.upper().replace("B", "C") * (i + 1)) for i in range(3)])
    wl = whitelist_csv(tmp_path, table)
    assert run_illumina(spark, str(tmp_path / "1"), str(tmp_path / "2"), wl, str(tmp_path / "o"))["matched"] == 6
    got = {n.split("_")[0][1:] + n[2:4].strip("_ACGT"): s for n, s in fasta(tmp_path / "o/read.bcd.illumina.fa.gz")}
    assert sorted(s for s in got.values()) == ["A", "AA", "AAA", "C", "CC", "CCC"]
    assert {n[0]: s[0] for n, s in got.items()} == {"a": "A", "b": "C"}
    os.remove(tmp_path / "2/b_R2.fq.gz")
    with pytest.raises(Exception, match="different numbers"):
        run_illumina(spark, str(tmp_path / "1"), str(tmp_path / "2"), wl, str(tmp_path / "o2"))


def test_lanes_of_any_size(spark, tmp_path):
    """Each lane is a file of its own, however few its reads, so that both sides of pairs have the same files."""
    ks = [0, *range(1, 300, 3), *range(2, 300, 3)]
    _lanes(spark.createDataFrame([(k, f"r{k}", "ACGT") for k in ks], "k long, name string, seq string"), "seq", str(tmp_path / "l"))
    files = sorted(x for x in os.listdir(tmp_path / "l") if x.endswith(".gz"))
    names = [[int(x[2:].split()[0]) for x in gzip.open(tmp_path / "l" / f, "rt").read().splitlines()[::4]] for f in files]
    assert names == [[0], list(range(1, 300, 3)), list(range(2, 300, 3))]


def test_several_bam_files(spark, tmp_path):
    register(spark)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.bam").write_bytes(bam_bytes([("t0", 5), ("t1", 6)], [("a_A_C", 0, 1)]))
    (tmp_path / "b/2.bam").write_bytes(bam_bytes([("t0", 5), ("t1", 6)], [("b_A_G", 0, 0)]))
    load = lambda kind: spark.read.format(kind).load(str(tmp_path / "b"))
    assert [(r.tid, r.name, r.length) for r in load("bam_references").orderBy("tid").collect()] == [(0, "t0", 5), (1, "t1", 6)]
    assert run_count(spark, str(tmp_path / "b"), str(tmp_path / "o"), one_file=False) == {"cells": 1, "transcripts": 2, "nnz": 2, "molecules": 2, "deduped": 2}
    parts = sorted(x for x in os.listdir(tmp_path / "o/matrix.mtx.gz") if x.endswith(".gz"))
    assert parts[0] == "head.gz" and b"".join(gzip.decompress((tmp_path / "o/matrix.mtx.gz" / x).read_bytes()) for x in parts).decode().splitlines()[2:] == ["1\t2\t2", "1\t1\t1", "1\t2\t1"]
    (tmp_path / "b/3.bam").write_bytes(bam_bytes([("t1", 6), ("t0", 5)], [("b_A_T", 0, 0)]))
    with pytest.raises(Exception, match="other targets"):
        load("bam_references").collect()


def test_names_that_counting_drops(spark, tmp_path, capfd):
    table = make_whitelist()
    parts = [RC(x) for x in table[5]]
    read = "ACGT" * 20 + "ACGTACGTACGT" + parts[0] + "CTCGA" + parts[1] + "CTC" + parts[2] + "CAT" + parts[3]
    fastq(tmp_path / "r.fq.gz", [("plain", read), ("with_mark", read)])
    argv = ["barcode", "--nanopore", "--r1", str(tmp_path / "r.fq.gz"), "--whitelist", whitelist_csv(tmp_path, table), "-o", str(tmp_path / "o")]
    assert cli.main(argv, spark) == 0
    assert "1 matched reads have '_'" in capfd.readouterr().err


def test_fastx_forms(spark, tmp_path):
    register(spark)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.fa").write_text(">one two\nAC\nGT\n>empty\n\n>last\nA")
    (tmp_path / "x/b.fq.gz").write_bytes(gzip.compress(b"@p\r\nAC\r\n+\r\n@@\r\n") + gzip.compress(b"@q\nACGT\n+q\n+@+@\n@r\n\n+\n\n"))
    got = [(r.file, r.read_idx, r.name, r.seq) for r in spark.read.format("fastx").load(str(tmp_path / "x")).orderBy("file", "read_idx").collect()]
    assert got == [("a.fa", 0, "one", "ACGT"), ("a.fa", 1, "empty", ""), ("a.fa", 2, "last", "A"), ("b.fq.gz", 0, "p", "AC"), ("b.fq.gz", 1, "q", "ACGT"), ("b.fq.gz", 2, "r", "")]
    (tmp_path / "bad.fq").write_text("@p\nACGT\n+\n@")
    with pytest.raises(Exception, match="end early"):
        spark.read.format("fastx").load(str(tmp_path / "bad.fq")).collect()


def test_count_run(spark, tmp_path):
    rows = [(f"r{i}_{'ACGT'[i % 4] * 3}_{'ACGT'[i % 3] * 5}", 4 if i % 7 == 0 else 0, None if i % 7 == 0 else i % 5) for i in range(500)] + [(None, 0, 1)]
    (tmp_path / "a.bam").write_bytes(bam_bytes([(f"t{i}", 100 + i) for i in range(5)], rows, block=777))
    register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "a.bam")).orderBy("rec_idx").collect()
    assert [(r.read_name, r.flag, r.tid) for r in got] == rows
    assert cli.main(["count", "--b1", str(tmp_path / "a.bam"), "-o", str(tmp_path / "out")], spark) == 0
    lines = gzip.open(tmp_path / "out/matrix.mtx.gz", "rt").read().splitlines()
    want = {(i % 4, i % 3, i % 5) for i in range(500) if i % 7}
    assert lines[2] == f"4\t5\t{len({(a, c) for a, _, c in want})}"
    assert sum(float(x.split("\t")[2]) for x in lines[3:]) == pytest.approx(len(want))


def test_streams(spark, tmp_path):
    table = make_whitelist()
    words = whitelist.dictionary(whitelist.read_whitelist(spark, whitelist_csv(tmp_path, table)))
    reads = make_reads(table, 40)
    df = spark.createDataFrame(reads, "name string, seq string").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = assign_stream(stream, words).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    want = plain_words(table)
    assert {r.name: r.status for r in spark.table("assigned").collect()} == {n: plain_nanopore(s, want)[0] for n, s in reads}
    m = spark.createDataFrame([("c", "u", [1]), ("c", "u", [1]), ("c", "v", [1])] * 3, "cell string, umi string, txps array<int>")
    m.repartition(4).write.parquet(str(tmp_path / "m"))
    s = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    q = dedup_stream(s).writeStream.format("memory").queryName("deduped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduped").count() == 2
