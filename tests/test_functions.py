import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidewell.functions import sequence as Q
from tidewell.functions.chemistry import CHEMISTRIES, PIPSEQ_V4
from tidewell.functions.seal import ANCHOR, extract, fit_ends, fit_walks, seal_extract


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_scalars(spark):
    s = F.col("s")
    got = values(spark, [("ACGT",), ("AAAC",), ("ACGTN",), ("acgt",), ("",), (None,)], "s string", Q.revcomp(s), Q.encode_base(s))
    assert got == [("ACGT", "0123"), ("GTTT", "0001"), ("NACGT", None), ("tgca", None), ("", ""), (None, None)]
    v = F.col("v")
    assert values(spark, [(96,), (0,), (27,)], "v long", Q.render_2bit(v, 16), Q.render_2bit(v, 3)) == [
        ("A" * 12 + "CGAA", "GAA"),
        ("A" * 16, "AAA"),
        ("A" * 13 + "CGT", "CGT"),
    ]
    rows = [F.col(c) for c in "abcd"]
    packed = values(spark, [(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (95, 95, 95, 95), (96, 0, 0, 0), (None, 0, 0, 0), (0, 0, -1, 0)], "a long, b long, c long, d long", Q.cell_pack(rows))
    assert [p[0] for p in packed] == [0, 1, 96, 96**4 - 1, None, None, None]
    names = [("r_ACGT_AC",), ("r_AACGT_AC",), ("r_ACGT",), ("r_A_C_G",), ("r_ACN_AC",), ("r__",), (f"r_{'A' * 33}_A",), ("r_A_an",)]
    keys = [r[0] and tuple(r[0]) for r in values(spark, names, "s string", Q.parse_key(s))]
    assert keys == [("A" * 28 + "ACGT", "AC"), ("A" * 28 + "ACGT", "AC"), None, None, None, ("A" * 32, ""), None, None]
    assert values(spark, [("AC",), ("AAC",), ("ACGTN",), ("",)], "s string", Q.umi_parse(s), Q.umi_length(s)) == [("AC", 2), ("AAC", 3), (None, 5), ("", 0)]
    assert values(spark, [("a b\tc",), ("a\tb c",), ("a",)], "s string", Q.read_name(s)) == [("a",)] * 3


def test_patterns_agree_with_and_without_anchor():
    import re

    own = random.Random(1)
    for reverse in (True, False):
        plain, names = PIPSEQ_V4.pattern(reverse, anchored=False)
        anchored, _ = PIPSEQ_V4.pattern(reverse)
        for _ in range(300):
            seg = ["".join(own.choices("ACGT", k=n)) for n in (8, 6, 6, 8, 12, 60)]
            core = seg[5] + seg[4] + seg[3] + "CTCGA" + seg[2] + "CTC" + seg[1] + "CAT" + seg[0]
            if not reverse:
                core = core[::-1].translate(str.maketrans("ACGT", "TGCA"))
            s = own.choice(["", "N", "AC"]) + core + own.choice(["", "N" + core, core, "GGG"])
            find = lambda p: [m.groups() for m in re.finditer(p, s)]  # noqa: E731, B023
            assert find(plain) == find(anchored)
    assert CHEMISTRIES["pipseq_v4"] is PIPSEQ_V4 and set(names) == {"flank", "bc1", "bc2", "bc3", "bc4", "umi", "seq"}


def plain_fit(read):
    """Best fit by memoised recursion: (start, end, read position after each column)."""

    @lru_cache(None)
    def best(i, j):
        if j == 0:
            return 0
        return max(diagonal(i, j), inserted(i, j), deleted(i, j))

    @lru_cache(None)
    def diagonal(i, j):
        return best(i - 1, j - 1) + (2 if read[i - 1] == ANCHOR[j - 1] else -1) if i else -(10**6)

    @lru_cache(None)
    def inserted(i, j):
        return max(inserted(i - 1, j) - 2, best(i - 1, j) - 3) if i else -(10**6)

    @lru_cache(None)
    def deleted(i, j):
        if j == 0:
            return -(10**6)
        return max(deleted(i, j - 1) - 2, best(i, j - 1) - 3)

    n = len(ANCHOR)
    end = max(range(len(read) + 1), key=lambda i: (best(i, n), -i))
    i, j, at, state = end, n, {}, "any"
    while j:
        if state == "any":
            if i and best(i, j) == diagonal(i, j):
                at[j] = i
                i, j = i - 1, j - 1
                continue
            state = "in" if best(i, j) == inserted(i, j) else "out"
        if state == "in":
            state = "any" if inserted(i, j) == best(i - 1, j) - 3 else "in"
            i -= 1
        else:
            at[j] = i
            state = "any" if deleted(i, j) == best(i, j - 1) - 3 else "out"
            j -= 1
    return i, end, at


def plain_extract(read):
    if read is None or len(read) < len(ANCHOR):
        return None
    a, end, at = plain_fit(read)
    if a < 40 or end + 8 > len(read) or at[23] + 8 > len(read):
        return None
    return (read[at[23] : at[23] + 8], read[at[14] : at[20]], read[at[5] : at[11]], read[a - 8 : a], read[a - 20 : a - 8], read[: a - 20])


def damaged(own):
    seg = lambda n: "".join(own.choices("ACGT", k=n))
    anchor = list("CTCGA" + seg(6) + "CTC" + seg(6) + "CAT")
    for _ in range(own.randint(0, 4)):
        at = own.randrange(len(anchor))
        anchor[at : at + 1] = own.choice([[], [own.choice("ACGT")], [anchor[at], own.choice("ACGTN")], []])
        anchor = anchor or ["A"]
    return seg(own.randint(0, 60)) + seg(12) + seg(8) + "".join(anchor) + seg(8) + seg(own.randint(0, 15))


def test_seal_against_plain():
    own = random.Random(11)
    reads = [damaged(own) for _ in range(400)] + ["A" * 23, "A" * 22, "", None, "CTCGA" * 20, "ACGT" * 30, "C" * 90]
    assert extract(reads) == [plain_extract(r) for r in reads]
    whole = [r.encode() for r in reads if r]
    ends = fit_ends(whole)
    for r, e, walk in zip(whole, ends.tolist(), fit_walks(whole, ends), strict=True):
        if len(r) >= 23:
            a, end, at = plain_fit(r.decode())
            assert (end, a) == (e, walk[0]) and all(walk[j] == i for j, i in at.items())


def test_seal_column(spark):
    read = "GAGAGAGAGAGAGAGAGAGAGAGAGAGAGA" + "ACACACGTGTGT" + "AAGGTTCC" + "CTCGA" + "GGAACC" + "CTC" + "TTGGAA" + "CAT" + "CCTTGGAA" + "TATATATATA"
    df = spark.createDataFrame([(read,), (None,), (read[20:],), (read[:76],)], "s string")
    got = [tuple(r.x) for r in df.select(seal_extract(F.col("s")).alias("x")).collect()]
    none = (None,) * 6
    assert got == [("CCTTGGAA", "TTGGAA", "GGAACC", "AAGGTTCC", "ACACACGTGTGT", read[:30]), none, none, none]


@pytest.mark.parametrize("n", [10_000])
def test_pattern_is_not_quadratic(spark, n):
    import time

    from tidewell.operators.assign import captured

    read = "".join(random.Random(2).choices("ACGT", k=n))
    df = spark.createDataFrame([(read,)] * 8, "s string").select(captured(F.col("s"), PIPSEQ_V4, True).alias("c"))
    df.collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 5
