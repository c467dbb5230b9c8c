import gzip
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_functions import plain_extract
from tidewell.functions.chemistry import PIPSEQ_V4
from tidewell.operators import abundance, assign, matrix, molecules, whitelist
from tidewell.plans import derive

RC = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def make_whitelist(seed=4, rows=24):
    own = random.Random(seed)
    seg = lambda n: "".join(own.choices("ACGT", k=n))
    return [[seg(8), seg(6), seg(6), seg(8)] for _ in range(rows)]


def plain_neighbours(k):
    out = set()
    for i in range(len(k)):
        cut = k[:i] + k[i + 1 :]
        out |= {cut} | {cut + c for c in "ACGT"} | {c + cut for c in "ACGT"} | {k[:i] + c + k[i + 1 :] for c in "ACGT"}
    for i in range(len(k) + 1):
        for c in "ACGT":
            put = k[:i] + c + k[i:]
            out |= {put, put[1:], put[:-1]}
    return out


def plain_words(table):
    words = [{} for _ in range(4)]
    for segment in range(4):
        near = {}
        for n, row in enumerate(table):
            for x in plain_neighbours(RC(row[3 - segment])):
                near[x] = n if near.get(x, n) == n else -1
        words[segment] = near | {RC(row[3 - segment]): n for n, row in enumerate(table)}
    return words


def plain_resolve(words, segments):
    rows = [w.get(s) for w, s in zip(words, segments, strict=True)]
    if all(r is not None and 0 <= r < 96 for r in rows):
        return sum(r * 96**i for i, r in enumerate(rows)), False
    return None, -1 in rows


def plain_nanopore(read, words):
    import re

    if len(read) < 40:
        return ("small", None, None, None, None)
    doubt = False
    for reverse in (True, False):
        found = [dict(zip(PIPSEQ_V4.pattern(reverse)[1], m.groups(), strict=True)) for m in re.finditer(PIPSEQ_V4.pattern(reverse)[0], read)]
        if len(found) == 1 and len(found[0]["seq"]) >= 50:
            m = found[0]
            cell, ambiguous = plain_resolve(words, [m[f"bc{i}"] if reverse else RC(m[f"bc{i}"]) for i in range(1, 5)])
            if cell is not None:
                return ("matched", cell, m["umi"], m["seq"], reverse)
            doubt |= ambiguous
    for way in (read, RC(read)):
        if got := plain_extract(way):
            cell, ambiguous = plain_resolve(words, got[:4])
            if cell is not None:
                return ("matched", cell, got[4], got[5], True)
            doubt |= ambiguous
    return ("ambiguous" if doubt else "mismatch", None, None, None, None)


def whitelist_csv(tmp_path, table):
    path = tmp_path / "whitelist.csv"
    path.write_text("a,b,c,d\n" + "\n".join(",".join(r) for r in table) + "\n")
    return str(path)


def make_reads(table, n=160, seed=9):
    own = random.Random(seed)
    seg = lambda k: "".join(own.choices("ACGT", k=k))
    out = []
    for i in range(n):
        parts = [RC(own.choice(table)[j]) for j in range(4)]
        links = ["CTCGA", "CTC", "CAT"]
        where = own.randrange(8)
        if where < 4:
            p, at = parts[where], own.randrange(len(parts[where]))
            parts[where] = own.choice([p, p[:at] + own.choice("ACGT") + p[at + 1 :], p[:at] + p[at + 1 :], p[:at] + own.choice("ACGT") + p[at:]])
        elif where < 7:
            k = own.randrange(3)
            links[k] = own.choice([links[k], links[k][1:], links[k][:1] + own.choice("ACGT") + links[k][2:]])
        read = seg(own.choice([20, 48, 52, 90])) + seg(12) + parts[0] + links[0] + parts[1] + links[1] + parts[2] + links[2] + parts[3] + seg(own.randint(0, 12))
        read = own.choice([read, read, RC(read), read[:30], read + "N" + read, seg(120), read[:20] + "N" + read[20:]])
        out.append((f"read{i}", read))
    return out


def test_whitelist(spark, tmp_path):
    table = make_whitelist()
    wl = whitelist.read_whitelist(spark, whitelist_csv(tmp_path, table))
    got = {(r.segment, r.key): r.row for r in whitelist.dictionary(wl).collect()}
    assert got == {(s, k): v for s, w in enumerate(plain_words(table)) for k, v in w.items()}
    repeats = spark.createDataFrame([(0, 0, "ACGT"), (0, 1, "ACGT"), (1, 0, "")], whitelist.SCHEMA)
    found = {(r.segment, r.key): r.row for r in whitelist.dictionary(repeats).collect()}
    assert found[0, "ACGT"] == 1 and found[0, "ACG"] == -1 and found[1, ""] == 0 and found[1, "A"] == 0
    counts = spark.createDataFrame([("A" * 8,), ("A" * 6,)], "k string").select(F.size(whitelist.edit1_neighbours(F.col("k")))).collect()
    assert [r[0] for r in counts] == [212, 162]
    with pytest.raises(ValueError, match="5 fields"):
        whitelist.read_whitelist(spark, whitelist_csv(tmp_path, [["A"] * 5]))


def test_nanopore(spark, tmp_path):
    table = make_whitelist()
    words = whitelist.dictionary(whitelist.read_whitelist(spark, whitelist_csv(tmp_path, table)))
    reads = make_reads(table) + [("none", None), ("low", "acgt" * 30)]
    df = spark.createDataFrame(reads, "name string, seq string").withColumn("extra", F.lit(1))
    want = plain_words(table)
    got = {r.name: (r.status, r.cell, r.umi, r.cdna, r.is_polya) for r in assign.assign_nanopore(df, words).collect()}
    assert got == {n: plain_nanopore(s or "", want) for n, s in reads}
    seen = Counter(v[0] for v in got.values())
    assert {"matched", "small", "ambiguous", "mismatch"} == set(seen)
    row = assign.stats(assign.assign_nanopore(df, words)).first().asDict()
    assert row["total"] == len(reads) and all(row[s] == seen.get(s, 0) for s in assign.STATUSES)
    assert assign.stats(assign.assign_nanopore(df.limit(0), words)).first()["total"] == 0


def test_pairs_must_have_equal_counts(spark):
    a = spark.createDataFrame([(0, "x", "A"), (1, "y", "C")], "read_idx long, name string, seq string")
    assert [(r.name, r.r1, r.r2) for r in assign.paired(a, a).orderBy("read_idx").collect()] == [("x", "A", "A"), ("y", "C", "C")]
    with pytest.raises(Exception, match="different numbers"):
        assign.paired(a, a.limit(1)).collect()


def test_molecules(spark):
    key = lambda n: f"{n}_ACGT_AC"
    rows = [(key("a"), 0, 5), (key("a"), 256, 3), (key("a"), 2048, 9), (key("b"), 4, None), (key("b"), 0, 1), (key("c"), 2048, 1), ("bad", 0, 1), (None, 0, 7), (key("a"), 0, 5), (key("d"), 0, None), (key("e"), 2052, 2), (key("e"), 0, 2)]
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "file string, rec_idx long, read_name string, flag int, tid int")
    lists = lambda m: sorted(list(r.txps) for r in m.collect())
    assert lists(molecules.molecules(df)) == [[2], [3, 5, 5]]
    assert lists(molecules.molecules_by_run(df)) == [[2], [3, 5], [5]]
    found = spark.createDataFrame([("x", "u", [1]), ("x", "u", [1]), ("x", "u", [1, 1]), ("x", "v", [1]), ("y", "u", [1])], "cell string, umi string, txps array<int>")
    deduped = molecules.dedup_exact(found)
    assert deduped.count() == 4
    assert {(r.cell, tuple(r.txps)): r["count"] for r in molecules.eqclass_counts(deduped).collect()} == {("x", (1,)): 2, ("x", (1, 1)): 1, ("y", (1,)): 1}


@pytest.mark.parametrize(
    ("classes", "lengths", "want", "rounds"),
    [
        ([([0], 3), ([1], 5)], [100, 100], {0: 3, 1: 5}, None),
        ([([0, 1], 4)], [100, 100], {0: 2, 1: 2}, 2),
        ([([0, 1], 7), ([0], 2), ([1, 2], 5), ([2], 3)], [120, 300, 210], {0: 8.987854, 1: 0.029215664, 2: 7.98293}, 13),
        ([([0], 6), ([1], 4), ([0, 1], 5)], [100, 200, 150], {0: 9.999038, 1: 5.0009623}, 5),
        ([([1], 3), ([2], 2), ([1, 2], 4), ([0], 1)], [100, 200, 150], {0: 1, 1: 4.88978, 2: 4.11022}, 5),
        ([([0, 0], 3)], [100], {0: 3}, None),
        ([(list(range(120)), 1)], [100] * 120, {}, None),
    ],
)
def test_abundance(classes, lengths, want, rounds):
    got, n = abundance.optimise(classes, np.array(lengths))
    assert {k: pytest.approx(v, rel=1e-5) for k, v in want.items()} == got
    assert rounds in (None, n)


def test_matrix_and_sinks(spark, tmp_path):
    from tidewell.sources import sinks

    key = lambda n, c: f"{n}_{c}_AC{'ACGT'[n % 4]}"
    rows = [(key(0, "AA"), 0, 0), (key(1, "AA"), 0, 1), (key(2, "C"), 0, 1), (key(2, "C"), 256, 0), (key(3, "G"), 0, 0)]
    rows += [(key(4, "T"), 0, i) for i in range(2, 122)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rec_idx long, read_name string, flag int, tid int")
    targets = spark.createDataFrame([(i, f"t{i}", 100) for i in range(122)], "tid int, name string, length int")
    found = matrix.count_matrix(df, targets)
    head = sinks.write_matrix(found, str(tmp_path / "m"))
    assert head == {"cells": 4, "transcripts": 122, "nnz": 5}
    read = lambda n: gzip.open(tmp_path / "m" / n, "rt").read().splitlines()
    assert read("barcodes.tsv.gz") == ["A" * 16, "A" * 15 + "C", "A" * 15 + "G", "A" * 15 + "T"]
    assert read("features.tsv.gz")[:2] == ["t0", "t1"] and len(read("features.tsv.gz")) == 122
    assert read("matrix.mtx.gz")[2:] == ["4\t122\t5", "1\t1\t1", "1\t2\t1", "2\t1\t0.5", "2\t2\t0.5", "3\t1\t1"]
    sinks.write_eqclass_text(molecules.molecules(df), targets, str(tmp_path / "eq.txt"))
    lines = (tmp_path / "eq.txt").read_text().splitlines()
    assert lines[:2] == ["122", "t0\t100"] and sorted(lines[123:])[2] == "A" * 15 + "C\tACG\tt0\tt1"
    assert [sinks.number(x) for x in (1.0, 0.1, 1e7, 0.029215664, 12345678)] == ["1", "0.1", "10000000", "0.029215664", "12345678"]


def test_anchor_that_fits_elsewhere(spark):
    """Read 88749 of the derived tables: a stretch of the turned read passes for an anchor, and the cascade takes it."""
    read = "TTTTCTTCAGATGGGGATGGAGTAACGTCGAGATACCGACATCCCTACTCGGTTATATTTTTATAAAAATTTAAAATTTTATAATTATAATAAAAAAATAATTTAATAATTATAAATTTTTAAATAAAAATA"
    keys = [[r["key"] for r in derive.frame(spark, "", derive.whitelist_sql(False)).where(f"segment = {s}").orderBy("row").collect()] for s in range(4)]
    want = plain_nanopore(read, plain_words([[RC(k) for k in reversed(row)] for row in zip(*keys, strict=True)]))
    assert want == ("matched", 59527866, "TCGAGATACCGA", "TTTTCTTCAGATGGGGATGGAGTAACG", True)
    reads = spark.createDataFrame([("read88749", read)], "name string, seq string")
    got = assign.assign_nanopore(reads, whitelist.dictionary(derive.frame(spark, "", derive.whitelist_sql(False)))).first()
    assert (got.status, got.cell, got.umi, got.cdna, got.is_polya) == want
