"""Registered queries over the derived tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions.chemistry import PIPSEQ_V4
from ..functions.seal import seal_extract
from ..operators import abundance, assign, matrix, molecules, whitelist
from ..sources import bam, shared
from ..sources.sinks import failed_records, passed_records
from . import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Inputs in Spark.


def _parts(spark, d):
    return derive.stored(spark, d, derive.parts_sql(False))


def _reads(spark, d):
    return derive.stored(spark, d, derive.reads_sql(False))


def _pairs(spark, d):
    return derive.stored(spark, d, derive.pairs_sql(False))


def _alignments(spark, d):
    return derive.stored(spark, d, derive.alignments_sql(False))


def _transcripts(spark, d):
    return derive.frame(spark, d, derive.transcripts_sql(False))


def _whitelist(spark):
    return derive.frame(spark, "", derive.whitelist_sql(False))


def _words(spark):
    return whitelist.dictionary(_whitelist(spark))


def _order():
    return F.struct("o1", "o2", "o3", "o4")


# Pieces of SQL.

RC = derive.rc
READS, PARTS, PAIRS = derive.reads_sql(True), derive.parts_sql(True), derive.pairs_sql(True)
WL = f"wl AS ({derive.whitelist_sql(True)})"
NEIGHBOURS = """
    letters AS (SELECT unnest(['A', 'T', 'C', 'G']) AS c),
    cut AS (SELECT segment, row, key, substr(key, 1, i - 1) || substr(key, i + 1) AS x FROM wl, unnest(range(1, length(key) + 1)) AS t(i)),
    put AS (SELECT segment, row, key, substr(key, 1, i) || c || substr(key, i + 1) AS x FROM wl, letters, unnest(range(0, length(key) + 1)) AS t(i)),
    near AS (
        SELECT segment, row, x AS neighbour FROM cut
        UNION SELECT segment, row, x || c FROM cut, letters
        UNION SELECT segment, row, c || x FROM cut, letters
        UNION SELECT segment, row, x FROM put
        UNION SELECT segment, row, substr(x, 2) FROM put
        UNION SELECT segment, row, substr(x, 1, length(key)) FROM put
        UNION SELECT segment, row, substr(key, 1, i - 1) || c || substr(key, i + 1) FROM wl, letters, unnest(range(1, length(key) + 1)) AS t(i))
"""
WORDS = f"""{WL}, {NEIGHBOURS},
    exact AS (SELECT segment, key, max(row) AS row FROM wl GROUP BY segment, key),
    words AS (SELECT * FROM exact UNION ALL
        SELECT segment, neighbour, CASE WHEN min(row) = max(row) THEN min(row) ELSE -1 END FROM near n
        WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.segment = n.segment AND e.key = n.neighbour) GROUP BY segment, neighbour)
"""


def looked_up(src: str, columns: list[str]) -> str:
    """``src`` with r0 to r3, cell and ambiguous."""
    joins = " ".join(f"LEFT JOIN words w{i} ON w{i}.segment = {i} AND w{i}.key = {c}" for i, c in enumerate(columns))
    ok = " AND ".join(f"w{i}.row BETWEEN 0 AND 95" for i in range(4))
    doubt = " OR ".join(f"coalesce(w{i}.row = -1, false)" for i in range(4))
    rows = ", ".join(f"w{i}.row AS r{i}" for i in range(4))
    packed = "w0.row + 96 * w1.row + 9216 * w2.row + 884736 * w3.row"
    return f"SELECT s.*, {rows}, CASE WHEN {ok} THEN {packed} END AS cell, ({doubt}) AS ambiguous FROM {src} s {joins}"


def captures(src: str, read: str, reverse: bool) -> str:
    """``src`` with n, bc1 to bc4, umi_ and seq_ by the plain pattern."""
    pattern, names = PIPSEQ_V4.pattern(reverse, anchored=False)
    groups = ", ".join(
        f"CASE WHEN len(m) > 0 THEN regexp_extract({read}, '{pattern}', {i + 1}) END AS c_{name}" for i, name in enumerate(names) if name != "flank"
    )
    return f"SELECT *, len(m) AS n, {groups} FROM (SELECT *, regexp_extract_all({read}, '{pattern}') AS m FROM {src}) x"


RENDER = "translate(to_base({0}, 4, 16), '0123', 'ACGT')"
KEY = "CASE WHEN regexp_full_match({0}, '[ACGT]{{0,32}}') THEN lpad({0}, 32, 'A') END"


# Scalar functions.


@query(f"SELECT k, {RC('seq')} AS turned, {RC(RC('seq'))} = seq AS back FROM ({READS}) r")
def revcomp(spark, d):
    seq = F.col("seq")
    return _reads(spark, d).select("k", Q.revcomp(seq).alias("turned"), (Q.revcomp(Q.revcomp(seq)) == seq).alias("back"))


@query(
    f"SELECT k, CASE WHEN regexp_full_match(seq, '[ACGT]*') THEN translate(seq, 'ACGT', '0123') END AS digits, "
    f"CASE WHEN regexp_full_match(seq, '[ACGT]*') THEN seq END AS letters FROM ({READS}) r"
)
def encode_base(spark, d):
    digits = Q.encode_base(F.col("seq"))
    return _reads(spark, d).select("k", digits.alias("digits"), Q.decode_base(digits).alias("letters"))


@query("SELECT o_orderkey AS k, translate(to_base((o_orderkey * 7919) % 4294967296, 4, 16), '0123', 'ACGT') AS rendered, right(translate(to_base((o_orderkey * 7919) % 4294967296, 4, 16), '0123', 'ACGT'), 5) AS low FROM orders")
def render_2bit(spark, d):
    v = (F.col("o_orderkey") * 7919) % 4294967296
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("k"), Q.render_2bit(v, 16).alias("rendered"), Q.render_2bit(v, 5).alias("low"))


_ROWS = derive.rows_of("o_orderkey")
_R0 = "CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 50 = 8 THEN 96 WHEN o_orderkey % 50 = 9 THEN -1 ELSE " + _ROWS[0] + " END"


@query(
    f"SELECT k, cell, {RENDER.format('cell')} AS rendered FROM (SELECT o_orderkey AS k, CASE WHEN ({_R0}) BETWEEN 0 AND 95 "
    f"THEN ({_R0}) + 96 * {_ROWS[1]} + 9216 * {_ROWS[2]} + 884736 * {_ROWS[3]} END AS cell FROM orders) t"
)
def cell_pack(spark, d):
    rows = [F.expr(_R0), *map(F.expr, _ROWS[1:])]
    cells = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), Q.cell_pack(rows).alias("cell"))
    return cells.withColumn("rendered", Q.cell_render(F.col("cell")))


@query(
    f"SELECT k, CASE WHEN regexp_full_match(u, '[ACGT]{{0,32}}') THEN u END AS umi, length(u) AS n, u = '' AS empty FROM "
    f"(SELECT k, CASE kind WHEN 0 THEN '' WHEN 1 THEN umi || 'N' WHEN 2 THEN seq ELSE umi END AS u FROM ({READS}) r) t"
)
def umi_parse(spark, d):
    u = F.expr("CASE kind WHEN 0 THEN '' WHEN 1 THEN umi || 'N' WHEN 2 THEN seq ELSE umi END")
    rows = _reads(spark, d).select("k", u.alias("u"))
    u = F.col("u")
    return rows.select("k", Q.umi_parse(u).alias("umi"), Q.umi_length(u).cast("long").alias("n"), Q.umi_is_empty(u).alias("empty"))


_NAMES = "CASE kind WHEN 0 THEN name WHEN 1 THEN name || '_' || umi WHEN 2 THEN name || '_' || bc1 || '_' || umi || '_x' WHEN 3 THEN name || '_' || bc1 || 'N_' || umi WHEN 4 THEN name || '__' ELSE name || '_' || bc1 || bc4 || '_' || umi END"


@query(
    f"SELECT k, CASE WHEN ok THEN cell END AS cell, CASE WHEN ok THEN right(cell, 16) END AS barcode, CASE WHEN ok THEN umi END AS umi FROM "
    f"(SELECT k, {KEY.format('p[2]')} AS cell, CASE WHEN regexp_full_match(p[3], '[ACGT]{{0,32}}') THEN p[3] END AS umi, "
    f"len(p) = 3 AND regexp_full_match(p[2], '[ACGT]{{0,32}}') AND regexp_full_match(p[3], '[ACGT]{{0,32}}') AS ok "
    f"FROM (SELECT k, string_split({_NAMES}, '_') AS p FROM ({READS}) r) t) t2"
)
def parse_key(spark, d):
    rows = _reads(spark, d).select("k", F.expr(_NAMES).alias("name")).withColumn("key", Q.parse_key(F.col("name")))
    return rows.select("k", F.col("key.cell").alias("cell"), Q.key_render(F.col("key.cell")).alias("barcode"), F.col("key.umi").alias("umi"))


# Whitelist.


@query(f"WITH {WL}, {NEIGHBOURS} SELECT segment, row, neighbour FROM near")
def edit1_neighbours(spark, d):
    return whitelist.neighbours(_whitelist(spark))


@query(f"WITH {WORDS} SELECT segment, key, row FROM words")
def whitelist_dictionary(spark, d):
    return _words(spark)


@query(f"WITH {WORDS}, p AS ({PARTS}) SELECT k, r0, r1, r2, r3, cell, ambiguous FROM ({looked_up('p', ['s.bc1', 's.bc2', 's.bc3', 's.bc4'])}) t")
def whitelist_resolve(spark, d):
    rows = [f"r{i}" for i in range(4)]
    found = whitelist.looked_up(_parts(spark, d), _words(spark), list(assign.SEGMENTS), rows)
    cols = [F.col(r) for r in rows]
    return found.select("k", *rows, Q.cell_pack(cols).alias("cell"), whitelist.is_ambiguous(cols).alias("ambiguous"))


# Assignment.


def _captured_sql(reverse: bool) -> str:
    parts = ", ".join(f"c_{n} AS {n}" for n in ("bc1", "bc2", "bc3", "bc4", "umi", "seq"))
    return f"SELECT k, CAST(n AS INTEGER) AS n, {parts} FROM ({captures(f'(SELECT k, seq FROM ({READS}) r)', 'seq', reverse)}) t"


def _captured(spark, d, reverse):
    return _reads(spark, d).select("k", assign.captured(F.col("seq"), PIPSEQ_V4, reverse).alias("c")).select("k", "c.*")


@query(_captured_sql(False))
def regex_extract_forward(spark, d):
    return _captured(spark, d, False)


@query(_captured_sql(True))
def regex_extract_reverse(spark, d):
    return _captured(spark, d, True)


_BCS = ["c_bc1", "c_bc2", "c_bc3", "c_bc4"]
ILLUMINA = f"""WITH {WORDS}, p AS ({PAIRS}),
    c AS ({captures(f"(SELECT *, {RC('r1')} AS turned FROM p)", 'turned', True)}),
    a AS ({looked_up('c', [f"CASE WHEN s.n = 1 THEN {RC('s.' + b)} END" for b in _BCS])}),
    assigned AS (SELECT k, name, CASE WHEN n = 0 THEN 'no_regex' WHEN n > 1 THEN 'multi' WHEN cell IS NOT NULL THEN 'matched'
                 WHEN ambiguous THEN 'ambiguous' ELSE 'mismatch' END AS status, cell,
                 CASE WHEN cell IS NOT NULL THEN c_umi END AS umi, CASE WHEN cell IS NOT NULL THEN r2 END AS cdna FROM a)
"""
_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in assign.STATUSES)


def _illumina(spark, d):
    return assign.assign_illumina(_pairs(spark, d), _words(spark))


@query(f"{ILLUMINA} SELECT k, name, status, cell, umi, cdna FROM assigned")
def assign_illumina(spark, d):
    return _illumina(spark, d).select("k", "name", "status", "cell", "umi", "cdna")


@query(f"{ILLUMINA} SELECT {_COUNTS} FROM assigned")
def illumina_stats(spark, d):
    return assign.stats(_illumina(spark, d))


@query(f"{ILLUMINA} SELECT name || '_' || {RENDER.format('cell')} || '_' || umi AS id, cdna AS seq FROM assigned WHERE status = 'matched'")
def illumina_records(spark, d):
    return passed_records(_illumina(spark, d))


_LONG = "length(seq) >= 40"
NANOPORE = f"""WITH {WORDS}, r AS (SELECT k, name, seq FROM ({READS}) x),
    c1 AS ({captures('r', 'seq', True)}),
    a1 AS ({looked_up('c1', [f"CASE WHEN s.n = 1 AND length(s.c_seq) >= 50 AND length(s.seq) >= 40 THEN s.{b} END" for b in _BCS])}),
    c2 AS ({captures('r', 'seq', False)}),
    a2 AS ({looked_up('c2', [f"CASE WHEN s.n = 1 AND length(s.c_seq) >= 50 AND length(s.seq) >= 40 THEN {RC('s.' + b)} END" for b in _BCS])}),
    assigned AS (SELECT a1.k, a1.name, a1.seq,
        CASE WHEN length(a1.seq) < 40 THEN 'small' WHEN a1.cell IS NOT NULL OR a2.cell IS NOT NULL THEN 'matched'
             WHEN a1.ambiguous OR a2.ambiguous THEN 'ambiguous' ELSE 'mismatch' END AS status,
        coalesce(a1.cell, a2.cell) AS cell,
        CASE WHEN a1.cell IS NOT NULL THEN a1.c_umi WHEN a2.cell IS NOT NULL THEN a2.c_umi END AS umi,
        CASE WHEN a1.cell IS NOT NULL THEN a1.c_seq WHEN a2.cell IS NOT NULL THEN a2.c_seq END AS cdna,
        CASE WHEN a1.cell IS NOT NULL THEN true WHEN a2.cell IS NOT NULL THEN false END AS is_polya
        FROM a1 JOIN a2 USING (k))
"""


def _by_regex(spark, d):
    return assign.assign_nanopore(_reads(spark, d).select("k", "name", "seq"), _words(spark), rescue=False)


@query(f"{NANOPORE} SELECT k, status, cell, umi, cdna, is_polya FROM assigned")
def assign_nanopore_regex(spark, d):
    return _by_regex(spark, d).select("k", "status", "cell", "umi", "cdna", "is_polya")


@query(f"{NANOPORE} SELECT name || '_' || {RENDER.format('cell')} || '_' || CASE WHEN is_polya THEN umi ELSE {RC('umi')} END AS id, CASE WHEN is_polya THEN cdna ELSE {RC('cdna')} END AS seq FROM assigned WHERE status = 'matched'")
def passed_reads(spark, d):
    return passed_records(_by_regex(spark, d))


@query(f"{NANOPORE} SELECT name AS id, seq FROM assigned WHERE status <> 'matched'")
def failed_reads(spark, d):
    return failed_records(_by_regex(spark, d))


@query(f"SELECT k, bc1, bc2, bc3, bc4, umi, cdna FROM ({READS}) r WHERE kind IN (0, 1, 4, 5, 7)")
def seal_extract_clean(spark, d):
    """The rescue on reads whose anchor is whole: it must return the parts they were made of."""
    reads = _reads(spark, d).where("kind in (0, 1, 4, 5, 7)").select("k", "seq")
    return reads.withColumn("s", seal_extract(F.col("seq"))).select("k", "s.*")


@query()
def seal_extract_all(spark, d):
    """The rescue on every read, damaged anchors included; tested against a plain alignment, which SQL can't express."""
    return _reads(spark, d).select("k", "seq").withColumn("s", seal_extract(F.col("seq"))).select("k", "s.*")


def _nanopore(spark, d):
    return assign.assign_nanopore(_reads(spark, d).select("k", "name", "seq"), _words(spark))


# Reads that the patterns leave open are rescued to what they were made of, whatever was done to their linkers or
# segments.  Why others fail (ambiguous or not found) may hang on where the anchor happens to fit in the other strand,
# so SQL knows of them only that they fail; the tests compare the two with a plain cascade.
CASCADE = f"""{NANOPORE}, p AS ({PARTS}), truth AS ({looked_up('p', ['s.bc1', 's.bc2', 's.bc3', 's.bc4'])}),
    final AS (SELECT a.k, CASE WHEN a.status IN ('small', 'matched') THEN a.status WHEN t.cell IS NOT NULL THEN 'matched' ELSE 'failed' END AS outcome,
        CASE WHEN a.status = 'small' THEN NULL ELSE coalesce(a.cell, t.cell) END AS cell,
        CASE WHEN a.status = 'matched' THEN a.umi WHEN a.status <> 'small' AND t.cell IS NOT NULL THEN t.umi END AS umi,
        CASE WHEN a.status = 'matched' THEN a.cdna WHEN a.status <> 'small' AND t.cell IS NOT NULL THEN t.cdna END AS cdna,
        CASE WHEN a.status = 'matched' THEN a.is_polya WHEN a.status <> 'small' AND t.cell IS NOT NULL THEN true END AS is_polya
        FROM assigned a JOIN truth t USING (k))
"""


def _outcomes(spark, d):
    failed = F.col("status").isin("ambiguous", "mismatch")
    return _nanopore(spark, d).withColumn("outcome", F.when(failed, "failed").otherwise(F.col("status")))


@query(f"{CASCADE} SELECT k, outcome, cell, umi, cdna, is_polya FROM final")
def assign_nanopore(spark, d):
    """The whole cascade: patterns on both strands, then the rescue on both."""
    return _outcomes(spark, d).select("k", "outcome", "cell", "umi", "cdna", "is_polya")


@query(f"{CASCADE} SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome = 'small') AS small, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM final")
def nanopore_stats(spark, d):
    counts = assign.stats(_nanopore(spark, d))
    return counts.select("total", "matched", "small", (F.col("ambiguous") + F.col("mismatch")).alias("failed"))


# Sources and sinks: what is written is read back.


@query(f"WITH {WL} SELECT CAST(segment AS INTEGER) AS segment, row, key FROM wl")
def whitelist_csv(spark, d):
    """The whitelist as a CSV file, barcode 4 first and reverse-complemented, and read again."""
    wide = _whitelist(spark).groupBy("row").pivot("segment", [3, 2, 1, 0]).agg(Q.revcomp(F.first("key")))
    path = shared.fresh_path(spark, "whitelist")
    wide.coalesce(1).orderBy("row").drop("row").write.csv(path, header=True)
    return whitelist.read_whitelist(spark, path)


def _lanes(df, seq: str, path: str) -> None:
    """FASTQ in three gzipped files, one a lane; the same rows in the same order for every ``seq`` of one table.

    Ranges won't do: their bounds come from a sample that differs from write to write.
    """
    lines = F.concat(F.lit("@"), "name", F.lit(" lane"), F.pmod("k", F.lit(3)).cast("string"), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq)))
    lanes = df.withColumn("lane", F.pmod("k", F.lit(3)).cast("int")).repartitionById(3, F.col("lane")).sortWithinPartitions("k")
    lanes.select(lines.alias("value")).write.text(path, compression="gzip")


@query(f"SELECT name, r1, r2 FROM ({PAIRS}) p")
def paired_reads(spark, d):
    """Pairs written as two folders of FASTQ files, and paired again by file and position."""
    bam.register(spark)
    path = shared.fresh_path(spark, "lanes")
    pairs = _pairs(spark, d).select("k", "name", "r1", "r2")
    for side in ("r1", "r2"):
        _lanes(pairs, side, f"{path}/{side}")
    load = lambda side: spark.read.format("fastx").load(f"{path}/{side}")
    return assign.paired(load("r1"), load("r2")).select("name", "r1", "r2")


@query(f"SELECT read_name, CAST(flag AS INTEGER) AS flag, tid FROM ({derive.alignments_sql(True)}) a")
def bam_records(spark, d):
    """Alignments written as BAM files and read again."""
    bam.register(spark)
    path = shared.fresh_path(spark, "bam")
    targets = [(r["name"], r["length"]) for r in _transcripts(spark, d).orderBy("tid").collect()]  # a bounded number of derived targets
    bam.write_bam(_alignments(spark, d).select("read_name", "flag", "tid"), targets, path)
    return spark.read.format("bam").load(path).select("read_name", "flag", "tid")


# Molecules.

ALIGNED, TARGETS = derive.alignments_sql(True), derive.transcripts_sql(True)


def molecules_sql(run: bool = False) -> str:
    src, keys, order = f"({ALIGNED}) a", "read_name", "(o1, o2, o3, o4)"
    if run:
        o = "(o5, o1, o2, o3, o4, k)"
        src = f"""(SELECT *, sum(new) OVER (PARTITION BY file ORDER BY o5, o1, o2, o3, o4, k ROWS UNBOUNDED PRECEDING) AS run FROM
            (SELECT *, CASE WHEN lag(read_name) OVER (PARTITION BY file ORDER BY o5, o1, o2, o3, o4, k) IS NOT DISTINCT FROM read_name THEN 0 ELSE 1 END AS new
             FROM (SELECT *, k % 16 AS file FROM ({ALIGNED}) a) b) c) e"""
        keys, order = "file, run, read_name", o
    return f"""(SELECT lpad(p[2], 32, 'A') AS cell, p[3] AS umi, txps FROM (
        SELECT string_split(read_name, '_') AS p, list_sort(list(tid) FILTER (WHERE tid IS NOT NULL)) AS txps, arg_min(flag & 4, {order}) AS unmapped
        FROM {src} WHERE flag & 2048 = 0 GROUP BY {keys}) g
        WHERE unmapped = 0 AND len(txps) > 0 AND len(p) = 3)"""


_JOINED = "array_to_string(txps, ',')"


def _found(spark, d):
    return molecules.molecules(_alignments(spark, d), _order())


def _shown(df):
    return df.withColumn("txps", F.array_join("txps", ","))


@query(f"SELECT cell, umi, {_JOINED} AS txps FROM {molecules_sql()} m")
def molecule_groups(spark, d):
    return _shown(_found(spark, d))


@query(f"SELECT cell, umi, {_JOINED} AS txps FROM {molecules_sql(True)} m")
def molecules_by_run(spark, d):
    rows = _alignments(spark, d).withColumn("file", F.col("k") % 16)
    return _shown(molecules.molecules_by_run(rows, "file", F.struct("o5", "o1", "o2", "o3", "o4", "k")))


@query(f"SELECT DISTINCT cell, umi, {_JOINED} AS txps FROM {molecules_sql()} m")
def dedup_exact(spark, d):
    return _shown(molecules.dedup_exact(_found(spark, d)))


@query(f"SELECT (SELECT count(*) FROM {molecules_sql()} m) AS raw, (SELECT count(*) FROM (SELECT DISTINCT cell, umi, txps FROM {molecules_sql()} m) x) AS deduped")
def molecule_counts(spark, d):
    """Raw and distinct molecules, in one pass: the distinct rows carry how many they stand for."""
    counted = _found(spark, d).groupBy("cell", "umi", "txps").agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count("*").alias("deduped"))


CLASSES = f"(SELECT cell, txps, CAST(count(*) AS INTEGER) AS count FROM (SELECT DISTINCT cell, umi, txps FROM {molecules_sql()} m) x GROUP BY cell, txps)"


def _classes(spark, d):
    return molecules.eqclass_counts(molecules.dedup_exact(_found(spark, d)))


@query(f"SELECT cell, {_JOINED} AS txps, count FROM {CLASSES} c")
def eqclass_counts(spark, d):
    return _shown(_classes(spark, d))


@query(
    f"""WITH m AS (SELECT *, row_number() OVER () AS id FROM {molecules_sql()} x),
    e AS (SELECT id, cell, umi, unnest(txps) AS tid, generate_subscripts(txps, 1) AS pos FROM m)
    SELECT right(cell, 16) || chr(9) || umi || chr(9) || string_agg(name, chr(9) ORDER BY pos) AS value FROM e JOIN ({TARGETS}) t USING (tid) GROUP BY id, cell, umi"""
)
def eqclass_text(spark, d):
    return molecules.eqclass_text(_found(spark, d), _transcripts(spark, d))


# Abundances.

EXPLODED = f"""
    c AS (SELECT *, row_number() OVER () AS id FROM {CLASSES} x),
    t AS ({TARGETS}),
    e AS (SELECT c.cell, c.id, c.count, len(c.txps) AS n, u.tid, t.length, min(t.length) OVER (PARTITION BY c.id) AS shortest
          FROM c, unnest(c.txps) AS u(tid) JOIN t ON t.tid = u.tid),
    start AS (SELECT cell, tid, (sum(CASE WHEN n = 1 THEN count ELSE 0 END) + 0.5) * 1e-3::DOUBLE AS a FROM (SELECT DISTINCT cell, id, count, n, tid FROM e) z GROUP BY cell, tid)
"""


@query(
    f"""WITH {EXPLODED} SELECT cell, tid, round(sum(CASE WHEN n = 1 THEN count ELSE count * w / total END), 6) AS alpha FROM
    (SELECT *, sum(w) OVER (PARTITION BY id) AS total FROM (SELECT e.*, a * shortest / length AS w FROM e JOIN start USING (cell, tid)) x) y GROUP BY cell, tid"""
)
def em_update(spark, d):
    classes = _classes(spark, d)
    step = abundance.update(abundance.starting(classes), classes, _transcripts(spark, d))
    return step.select("cell", "tid", F.round("alpha", 6).alias("alpha"))


EM = f"""WITH RECURSIVE {EXPLODED},
    em AS (
        SELECT cell, tid, a, 0 AS it, false AS fin FROM start
        UNION ALL
        SELECT cell, tid, b, it + 1, (it + 1 >= 2 AND bool_and(NOT (b > 0.01 AND abs(a - b) > 0.01)) OVER (PARTITION BY cell)) FROM (
            SELECT cell, tid, any_value(a) AS a, any_value(it) AS it, sum(CASE WHEN n = 1 THEN count WHEN total > 0 THEN count * w / total ELSE 0 END) AS b FROM (
                SELECT *, sum(w) OVER (PARTITION BY id) AS total FROM (
                    SELECT e.*, em.a, em.it, em.a * e.shortest / e.length AS w FROM em JOIN e ON e.cell = em.cell AND e.tid = em.tid WHERE NOT em.fin AND em.it < 100) x) y
            GROUP BY cell, tid) z),
    alpha AS (SELECT cell, tid, a FROM em WHERE it = (SELECT max(it) FROM em q WHERE q.cell = em.cell) AND a >= 0.01)
"""


@query(f"{EM} SELECT cell, tid, round(a, 3) AS alpha FROM alpha")
def em_abundance(spark, d):
    found = abundance.abundances(_classes(spark, d), _transcripts(spark, d))
    return found.select("cell", "tid", F.round(F.col("alpha").cast("double"), 3).alias("alpha"))


_CELLS = f"cells AS (SELECT cell, CAST(row_number() OVER (ORDER BY cell) AS INTEGER) AS row, right(cell, 16) AS barcode FROM (SELECT DISTINCT cell FROM {molecules_sql()} m) x)"


def _matrix(spark, d):
    return matrix.count_matrix(_alignments(spark, d), _transcripts(spark, d), _order())


@query(f"{EM}, {_CELLS} SELECT barcode, row, tid + 1 AS col, round(a, 3) AS value FROM alpha JOIN cells USING (cell)")
def count_matrix(spark, d):
    return _matrix(spark, d).triplets.select("barcode", "row", "col", F.round(F.col("value").cast("double"), 3).alias("value"))


@query(f"WITH {_CELLS} SELECT row, barcode FROM cells")
def matrix_barcodes(spark, d):
    return _matrix(spark, d).barcodes.select("row", "barcode")


@query(f"SELECT tid + 1 AS col, name FROM ({TARGETS}) t")
def matrix_features(spark, d):
    return _matrix(spark, d).features


@query(f"{EM}, {_CELLS} SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM ({TARGETS}) t) AS transcripts, (SELECT count(*) FROM alpha) AS nnz")
def matrix_header(spark, d):
    return _matrix(spark, d).header()
