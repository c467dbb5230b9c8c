"""Barcode assignment of single long reads and of read pairs.

A long read goes through up to four stages: the pattern of the reverse strand,
that of the forward strand, and the alignment rescue on the read and on its
reverse complement.  The first stage that resolves the barcode wins; an
ambiguous one is remembered.  All stages are columns of one pass: the rescue
sees only reads that the patterns left open, since the others reach it as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import PIPSEQ_V4, Chemistry
from ..functions.seal import seal_extract
from ..functions.sequence import cell_pack, revcomp
from .whitelist import is_ambiguous, looked_up

LEAST_READ, LEAST_CDNA = 40, 50
SEGMENTS = ("bc1", "bc2", "bc3", "bc4")
STATUSES = ("matched", "small", "no_regex", "multi", "ambiguous", "mismatch")


def _searched(read: Column, chemistry: Chemistry, reverse: bool) -> tuple[Column, Column]:
    """All matches of a strand's pattern, whole and by their leading open ends."""
    pattern, _ = chemistry.pattern(reverse)
    return F.regexp_extract_all(read, F.lit(pattern), F.lit(0)), F.regexp_extract_all(read, F.lit(pattern), F.lit(1))


def captured(read: Column, chemistry: Chemistry, reverse: bool, searched: tuple[Column, Column] | None = None) -> Column:
    """(n, bc1, bc2, bc3, bc4, umi, seq) by the pattern of a strand; n counts its matches.

    Two passes of the pattern: the widths of all parts but the two open ends are
    fixed, so one open end's length places every part.  ``searched`` has the
    results of both passes, if they are columns already.
    """
    _, names = chemistry.pattern(reverse)
    whole, lead = searched or _searched(read, chemistry, reverse)
    first, at = F.try_element_at(whole, F.lit(1)), F.length(F.try_element_at(lead, F.lit(1)))
    widths = {f"bc{i + 1}": n for i, n in enumerate(chemistry.segments)} | {"umi": chemistry.umi}
    links = list(chemistry.linkers)[::-1] if reverse else list(chemistry.linkers)
    parts: dict[str, Column] = {}
    offset, barcodes = 0, 0
    for name in names[1:-1]:
        parts[name] = F.substring(first, at + offset + 1, F.lit(widths[name]))
        offset += widths[name]
        if name.startswith("bc"):
            offset += len(links[barcodes]) if barcodes < len(links) else 0
            barcodes += 1
    rest = F.substring(first, at + offset + 1, F.length(first))
    parts["seq"] = F.try_element_at(lead, F.lit(1)) if reverse else rest
    return F.struct(F.size(whole).alias("n"), *[parts[k].alias(k) for k in (*SEGMENTS, "umi", "seq")])


def _resolved(df: DataFrame, words: DataFrame, stage: str, flip: bool) -> DataFrame:
    """Add ``{stage}_cell`` and ``{stage}_ambiguous`` from the segments of struct ``stage``."""
    names = [f"_{stage}{i}" for i in range(4)]
    for name, bc in zip(names, SEGMENTS, strict=True):
        segment = F.col(f"{stage}.{bc}")
        df = df.withColumn(name, revcomp(segment) if flip else segment)
    out = [f"{n}r" for n in names]
    df = looked_up(df, words, names, out)
    rows = [F.col(r) for r in out]
    return df.withColumn(f"{stage}_cell", cell_pack(rows)).withColumn(f"{stage}_ambiguous", is_ambiguous(rows)).drop(*names, *out)


def with_captures(df: DataFrame, name: str, read: Column, chemistry: Chemistry, reverse: bool) -> DataFrame:
    """``df`` with ``captured`` in ``name``.

    The passes are columns of a projection of their own: their arrays are used
    more than once, so the optimiser keeps that projection, where it would copy
    the passes into each use of a part.
    """
    whole, lead = f"{name}_whole", f"{name}_lead"
    found = _searched(read, chemistry, reverse)
    df = df.withColumns({whole: found[0], lead: found[1]})
    return df.withColumn(name, captured(read, chemistry, reverse, (F.col(whole), F.col(lead)))).drop(whole, lead)


def _pattern_stage(df: DataFrame, words: DataFrame, chemistry: Chemistry, stage: str, forward: bool, read: Column) -> DataFrame:
    df = with_captures(df, stage, read, chemistry, not forward)
    one = (F.col(f"{stage}.n") == 1) & (F.length(f"{stage}.seq") >= LEAST_CDNA)
    return _resolved(df.withColumn(stage, F.when(one, F.col(stage))), words, stage, forward)


def assign_nanopore(reads: DataFrame, words: DataFrame, chemistry: Chemistry = PIPSEQ_V4, rescue: bool = True) -> DataFrame:
    """``reads`` (name, seq, ...) with status, cell, umi, cdna and is_polya.

    status is matched, small, ambiguous or mismatch; the others are null unless
    matched, and are as read, not yet brought to one strand.  A null seq is
    small.  ``rescue`` adds the two alignment stages.
    """
    columns = reads.columns
    seq = F.coalesce(F.col("seq"), F.lit(""))
    long_enough = F.length(seq) >= LEAST_READ
    df = reads.withColumn("_read", F.when(long_enough, seq))
    stages = [("_rev", False), ("_fwd", True)]
    for stage, forward in stages:
        df = _pattern_stage(df, words, chemistry, stage, forward, F.col("_read"))
    if rescue:
        open_ = F.when(F.col("_rev_cell").isNull() & F.col("_fwd_cell").isNull(), F.col("_read"))
        df = _resolved(df.withColumn("_seal", seal_extract(open_)), words, "_seal", False)
        other = F.when(F.col("_seal_cell").isNull(), revcomp(open_))
        df = _resolved(df.withColumn("_back", seal_extract(other)), words, "_back", False)
        stages += [("_seal", False), ("_back", False)]
    hit = F.coalesce(*[F.col(f"{s}_cell") for s, _ in stages])
    doubt = F.lit(False)
    for s, _ in stages:
        doubt = doubt | F.col(f"{s}_ambiguous")

    def first(value) -> Column:
        out = F.lit(None)
        for s, forward in reversed(stages):
            out = F.when(F.col(f"{s}_cell").isNotNull(), value(s, forward)).otherwise(out)
        return out

    status = F.when(~long_enough, "small").when(hit.isNotNull(), "matched").when(doubt, "ambiguous").otherwise("mismatch")
    cdna = {"_rev": "seq", "_fwd": "seq", "_seal": "cdna", "_back": "cdna"}
    return df.select(
        *columns,
        status.alias("status"),
        hit.alias("cell"),
        first(lambda s, _: F.col(f"{s}.umi")).alias("umi"),
        first(lambda s, _: F.col(f"{s}.{cdna[s]}")).alias("cdna"),
        first(lambda _, forward: F.lit(not forward)).alias("is_polya"),
    )


def assign_illumina(pairs: DataFrame, words: DataFrame, chemistry: Chemistry = PIPSEQ_V4) -> DataFrame:
    """``pairs`` (name, r1, r2, ...) with status, cell, umi, cdna (all of r2) and is_polya.

    status is matched, no_regex, multi, ambiguous or mismatch.
    """
    columns = pairs.columns
    df = with_captures(pairs, "_rev", revcomp(F.coalesce(F.col("r1"), F.lit(""))), chemistry, True)
    df = df.withColumn("_n", F.col("_rev.n")).withColumn("_rev", F.when(F.col("_n") == 1, F.col("_rev")))
    df = _resolved(df, words, "_rev", True)
    hit = F.col("_rev_cell").isNotNull()
    status = F.when(F.col("_n") == 0, "no_regex").when(F.col("_n") > 1, "multi").when(hit, "matched")
    return df.select(
        *columns,
        status.when(F.col("_rev_ambiguous"), "ambiguous").otherwise("mismatch").alias("status"),
        F.col("_rev_cell").alias("cell"),
        F.when(hit, F.col("_rev.umi")).alias("umi"),
        F.when(hit, F.coalesce(F.col("r2"), F.lit(""))).alias("cdna"),
        F.when(hit, F.lit(True)).alias("is_polya"),
    )


def one_strand(assigned: DataFrame) -> DataFrame:
    """UMI and cDNA of all matched reads on the strand that carries the poly-A."""
    turn = lambda c: F.when(F.col("is_polya"), F.col(c)).otherwise(revcomp(F.col(c)))
    return assigned.withColumn("umi", turn("umi")).withColumn("cdna", turn("cdna"))


def stats(assigned: DataFrame) -> DataFrame:
    """One row: total and the count of each status."""
    return assigned.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def paired(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Pair two reads tables by position; unequal counts, of files or of reads in a file, are an error.

    Both have read_idx, name and seq, and file_idx if they were read from several
    files: read_idx starts anew in each, so the first file's reads meet those of
    the other side's first file.  A name with ``_`` in it would make a key that
    counting drops; ``keyed_names`` finds such names.
    """
    keys = [c for c in ("file_idx", "read_idx") if c in r1.columns and c in r2.columns]
    a = r1.select(*keys, "name", F.col("seq").alias("r1"))
    b = r2.select(*keys, F.col("seq").alias("r2"), F.lit(1).alias("_b"))
    both = a.withColumn("_a", F.lit(1)).join(b, keys, "full_outer")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    checked = F.when(bad, F.raise_error(F.lit("R1 and R2 have different numbers of records"))).otherwise(F.col("name"))
    return both.select(*keys, checked.cast("string").alias("name"), "r1", "r2")


def keyed_names() -> Column:
    """Whether a matched read's own name has ``_`` in it: ``parse_key`` drops what is keyed by it."""
    return (F.col("status") == "matched") & F.col("name").contains("_")
