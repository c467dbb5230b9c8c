"""Exact deduplication by salted, skew-safe combining.  Built-in functions only.

1. Each task combines its own equal texts (the map side of the first
   aggregation), so thousands of copies in one file leave it as one row.
2. Salted digest groups are merged: rows meet by (digest, salt), the salt
   being a hash of the id, so a text that a third of all rows share is spread
   over as many tasks as there are salts.
3. The winners of the salts, at most one per salt and text, are combined
   globally by digest.

The content itself is a grouping key of every stage, so rows whose digests
collide stay apart.  Neither stage collects a whole group: the salts grow with
the table, so that a list holds about ``LISTED`` ids of one salt at most, even if
all rows were copies of one text, and the global stage sees one row per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, flagged, shuffle_width, without, written

LISTED = 1_000_000


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_groups(df: DataFrame, content: Column, member: Column, digest: Column, salts: int | None = None):
    """Salted groups of equal ``content``, and the group that each belongs to.

    Returns two frames.  The first, ``parts``, has one row per salt and
    content: ``digest``, ``content``, ``members`` (sorted array of ``member``)
    and ``first`` (its least).  The second, ``whole``, maps each ``first`` (with
    its ``digest``) to ``keep``, the least member of the whole group, and
    ``size``.  ``member`` must be orderable; null members sort first.
    """
    salts = salts or max(shuffle_width(df.sparkSession), -(-df.count() // LISTED))
    rows = df.select(content.alias("content"), member.alias("member")).withColumn("digest", digest)
    # Null members would all have one salt: their place in the scan spreads them.
    spread = F.when(F.col("member").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("member"))
    rows = rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.array_sort(F.collect_list(F.struct("member"))).alias("members"))
    parts = salted.select("digest", "content", "members", F.col("members")[0].alias("first"))
    whole = (
        parts.groupBy("digest", "content")
        .agg(
            F.min("first").alias("keep"),
            F.sum(F.size("members")).alias("size"),
            F.collect_list("first").alias("firsts"),
        )
        .select("digest", "keep", "size", F.explode("firsts").alias("first"))
    )
    return parts, whole


def exact_dedup(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    salts: int | None = None,
    digest=lambda content: F.sha2(content, 256),
) -> DataFrame:
    """Mark all but the first of rows whose texts are equal after normalising.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.  Null text is empty text.  Of equal texts the
    row with the smallest id is kept; rows repeated with the same id and text
    are one group, of which exactly one row is kept.  A null id counts as the
    smallest.  Other columns of ``df`` are not read.  An empty table gives an
    empty result.  ``digest`` may be any function of the content: rows are
    compared by content, so collisions are harmless.
    """
    content = normalised(F.col(text_col))
    parts, whole = content_groups(df, content, F.col(id_col), digest(F.col("content")), salts)
    member = F.posexplode("members").alias("at", "row")
    rows = parts.select("digest", "first", F.sha2("content", 256).alias("text_sha256"), "members")
    joined = rows.join(whole, ["digest", "first"]).select("*", member)
    return joined.select(
        F.col("row.member").alias(id_col),
        F.col("keep.member").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        ((F.col("at") == 0) & F.col("first").eqNullSafe(F.col("keep"))).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Of rows repeated with one id and text one stays.  Texts whose hash no other
    row has are alone and don't move: ``exact_dedup`` gets the others.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(normalised(F.col(text_col))).alias("hash"))
    shared, hashes = written(rows.groupBy("hash").count().where("count > 1").select("hash"), "shared")
    likely, texts = written(flagged(rows, ["hash"], shared).where("known").select("text", "id"), "likely")
    key = lambda of: F.coalesce(F.concat(F.lit("i"), F.col(of).cast("string")), F.lit(""))
    marked = exact_dedup(likely, "text", "id").select(key("id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    out = without(df, marked.groupBy("id", "sha").agg(F.max("kept").alias("stays"), F.count("*").alias("times")), key(id_col), F.sha2(normalised(F.col(text_col)), 256))
    for path in (hashes, texts):  # the fates are a table of their own by now
        discard(df.sparkSession, path)
    return out
