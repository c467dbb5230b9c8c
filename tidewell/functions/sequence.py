"""Scalar functions over nucleotide strings; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a whitelist segment that a packed cell id can hold.
BASE = 96


def revcomp(s: Column) -> Column:
    """Reverse complement; letters other than ACGT stay as they are."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def encode_base(s: Column) -> Column:
    """Digits 0 to 3 for ACGT; null if any other letter occurs."""
    return F.when(s.rlike("^[ACGT]*$"), F.translate(s, "ACGT", "0123"))


def decode_base(digits: Column) -> Column:
    """Letters for digits; only the low two bits of a digit count."""
    return F.translate(digits, "01234567", "ACGTACGT")


def render_2bit(v: Column, n: int) -> Column:
    """The low 2n bits of a non-negative long as n letters, most significant first."""
    digits = F.lpad(F.conv(v.cast("string"), 10, 4), max(n, 32), "0")
    return F.translate(F.right(digits, F.lit(n)), "0123", "ACGT")


def cell_pack(rows: list[Column]) -> Column:
    """Packed id of four segment rows; null unless each is between 0 and 95."""
    ok = rows[0].isNotNull()
    for r in rows:
        ok = ok & r.isNotNull() & r.between(0, BASE - 1)
    packed = sum((r.cast("long") * F.lit(BASE**i) for i, r in enumerate(rows)), F.lit(0).cast("long"))
    return F.when(ok, packed)


def cell_render(cell: Column) -> Column:
    """A packed cell id as 16 letters."""
    return render_2bit(cell, 16)


def cell_key(cb: Column) -> Column:
    """Identity of a parsed barcode: up to 32 letters, value only, so leading As don't count; else null.

    A string of 32 letters; it sorts as the packed value does, and its last 16
    letters are the rendered barcode.
    """
    return F.when(cb.rlike("^[ACGT]{0,32}$"), F.lpad(cb, 32, "A"))


def key_render(key: Column) -> Column:
    return F.right(key, F.lit(16))


def umi_parse(umi: Column) -> Column:
    """A UMI of at most 32 letters ACGT, empty allowed; else null."""
    return F.when(umi.rlike("^[ACGT]{0,32}$"), umi)


def umi_length(umi: Column) -> Column:
    return F.length(umi)


def umi_is_empty(umi: Column) -> Column:
    return F.length(umi) == 0


def read_name(header: Column) -> Column:
    """A header up to its first space or tab."""
    return F.regexp_extract(header, "^([^ \t]*)", 1)


def parse_key(name: Column) -> Column:
    """(cell, umi) of a read name with exactly three fields joined by ``_``; null if malformed."""
    parts = F.split(name, "_")
    cell, umi = cell_key(F.try_element_at(parts, F.lit(2))), umi_parse(F.try_element_at(parts, F.lit(3)))
    ok = (F.size(parts) == 3) & cell.isNotNull() & umi.isNotNull()
    return F.when(ok, F.struct(cell.alias("cell"), umi.alias("umi")))


def record_id(name: Column, cell: Column, umi: Column) -> Column:
    """Name, rendered cell and UMI joined by ``_``."""
    return F.concat_ws("_", name, cell_render(cell), umi)
