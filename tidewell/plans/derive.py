"""Reads, a whitelist, alignments and transcripts made from the TPC-H-like tables.

Each expression is written once for both dialects, Spark and DuckDB, so that a
query and its SQL see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written

ROWS, LENGTHS = 96, (8, 6, 6, 8)
# Multiplier and offset of each segment's keys; odd, so keys are distinct.
KEYS = ((683, 17), (41, 7), (37, 1000), (677, 40001))
CELLS, UMIS, TARGETS = 64, 256, 40


def base4(v: str, n: int, duck: bool) -> str:
    if duck:
        return f"translate(lpad(to_base({v}, 4), {n}, '0'), '0123', 'ACGT')"
    return f"translate(lpad(conv(cast({v} as string), 10, 4), {n}, '0'), '0123', 'ACGT')"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def key(segment: int, row: str, duck: bool) -> str:
    n, (a, b) = LENGTHS[segment], KEYS[segment]
    return base4(f"(({row}) * {a} + {b}) % {4**n}", n, duck)


def whitelist_sql(duck: bool) -> str:
    series = f"(SELECT range AS r FROM range({ROWS}))" if duck else f"(SELECT id AS r FROM range({ROWS}))"
    parts = [f"SELECT {s} AS segment, CAST(r AS BIGINT) AS row, {key(s, 'r', duck)} AS key FROM {series}" for s in range(4)]
    return " UNION ALL ".join(parts)


def rows_of(k: str) -> list[str]:
    """The segment rows of read ``k``."""
    return [f"({k} % {ROWS})", f"(({k} * 7 + 3) % {ROWS})", f"(({k} * 11 + 5) % {ROWS})", f"(({k} * 13 + 1) % {ROWS})"]


def parts_sql(duck: bool) -> str:
    """k, kind, cdna, umi and bc1 to bc4 of each order; segments as the whitelist stores them."""
    k = "o_orderkey"
    r = rows_of(k)
    odd = (2654435761, 40503, 69069, 1103515245, 22695477)
    # Of A and T alone, so that the anchor, half of it C and G, hardly fits in it by chance, on either strand (one read of 150,000 at 0.1).
    cdna = " || ".join(base4(f"({k} * {m} + {i * 977 + 5}) % 4294967296", 16, duck) for i, m in enumerate(odd))
    cdna = f"translate({cdna}, 'CG', 'TA')"
    bc1, bc4 = key(0, r[0], duck), key(3, r[3], duck)
    return f"""
        SELECT {k} AS k, {k} % 12 AS kind,
               CASE {k} % 12 WHEN 7 THEN substr({cdna}, 1, 45) WHEN 10 THEN substr({cdna}, 1, 10) || 'N' || substr({cdna}, 11) ELSE {cdna} END AS cdna,
               {base4(f"({k} * 48271) % 16777216", 12, duck)} AS umi,
               CASE {k} % 12 WHEN 4 THEN translate(substr({bc1}, 1, 1), 'ACGT', 'CGTA') || substr({bc1}, 2) ELSE {bc1} END AS bc1,
               {key(1, r[1], duck)} AS bc2,
               CASE {k} % 12 WHEN 9 THEN substr({key(2, r[2], duck)}, 1, 3) || substr({key(2, r[2], duck)}, 5) ELSE {key(2, r[2], duck)} END AS bc3,
               CASE {k} % 12 WHEN 5 THEN 'GGGGGGGG' ELSE {bc4} END AS bc4
        FROM orders
    """


def reads_sql(duck: bool) -> str:
    """name, seq and the parts of each read: both strands, damaged in one of several ways by kind."""
    whole = "cdna || umi || bc4 || (CASE kind WHEN 8 THEN 'CTAGA' ELSE 'CTCGA' END) || bc3 || 'CTC' || bc2 || 'CAT' || bc1 || 'AA'"
    return f"""
        SELECT k, kind, cdna, umi, bc1, bc2, bc3, bc4, 'read' || CAST(k AS {'VARCHAR' if duck else 'STRING'}) AS name,
               CASE WHEN kind IN (2, 3) OR (kind IN (8, 9) AND k % 24 >= 12) THEN {rc('w')}
                    WHEN kind = 6 THEN substr(w, 1, 30)
                    WHEN kind = 11 THEN w || 'N' || w ELSE w END AS seq
        FROM (SELECT *, {whole} AS w FROM ({parts_sql(duck)}) p) q
    """


def pairs_sql(duck: bool) -> str:
    """name, r1 and r2 of read pairs."""
    # A pair's segments are turned twice before the lookup, so R1 has them as the whitelist stores them.
    flank = f"bc1 || 'ATG' || bc2 || (CASE kind WHEN 8 THEN 'GTG' ELSE 'GAG' END) || bc3 || 'TCGAG' || bc4 || {rc('umi')}"
    return f"""
        SELECT k, kind, 'pair' || CAST(k AS {'VARCHAR' if duck else 'STRING'}) AS name,
               CASE kind WHEN 6 THEN substr(w, 1, 20) WHEN 11 THEN w || 'N' || w ELSE w END AS r1, CASE kind WHEN 7 THEN '' ELSE cdna END AS r2
        FROM (SELECT *, {flank} AS w FROM ({parts_sql(duck)}) p) q
    """


def alignments_sql(duck: bool) -> str:
    """read_name, flag, tid and the columns that order records, from lineitem."""
    text = "VARCHAR" if duck else "STRING"
    k = "l_orderkey"
    return f"""
        SELECT CASE WHEN {k} % 29 = 0 THEN 'bad_' ELSE '' END || 'r' || CAST({k} AS {text}) || '_' || {base4(f"{k} % {CELLS}", 16, duck)} || '_'
                   || {base4(f"({k} {'//' if duck else 'DIV'} {CELLS}) % {UMIS}", 12, duck)} AS read_name,
               CASE WHEN l_linenumber % 7 = 0 THEN 2048 WHEN l_suppkey % 13 = 0 THEN 4 ELSE 0 END AS flag,
               CASE WHEN l_suppkey % 13 = 0 AND l_linenumber % 7 <> 0 THEN NULL ELSE CAST(l_partkey % {TARGETS} AS INTEGER) END AS tid,
               l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3, l_extendedprice AS o4, l_quantity AS o5, {k} AS k
        FROM lineitem
    """


def transcripts_sql(duck: bool) -> str:
    return f"""
        SELECT CAST(p_partkey AS INTEGER) AS tid, p_name AS name, CAST(200 + 37 * p_size AS INTEGER) AS length FROM part WHERE p_partkey < {TARGETS}
    """


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above in Spark, its table read from ``sf_dir``."""
    table = next(t for t in ("orders", "lineitem", "part", "") if not t or f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet")) if table else spark.sql(sql)


def stored(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``frame``, made once an application and read from the shared folder after that.

    The tables stand in for files of reads and alignments: queries should read them, not make them.
    """
    known = spark.sparkContext.__dict__.setdefault("_tidewell_derived", {})
    if (sf_dir, sql) not in known:
        known[sf_dir, sql], _ = written(frame(spark, sf_dir, sql), "derived")
    return known[sf_dir, sql]
