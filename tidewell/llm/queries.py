"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .bpe import Vocabulary, encoded
from .chat_format import CHAIN, format_pairs, sibling_pairs
from .common import fresh_path, salted_lookup, table, written
from .exact_dedup import exact_dedup, normalised
from .langid import predict, train
from .mixing import mix_documents
from .simhash import near_duplicates
from .token_counts import Rollup, counts_of
from .url_filter import article_outcomes, judge
from .warc import archive


def public_vocabulary() -> Vocabulary:
    """The public 50k byte-level BPE vocabulary of this machine's tokenizers."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive(table(spark, sf_dir, "pages"))
    return read.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "cut")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(sibling_pairs(table(spark, sf_dir, "conversations")))

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "prompt_turns",
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"),
        F.length("prompt").alias("prompt_chars"),
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, article_outcomes(pages, table(spark, sf_dir, "labels"))).drop("host_bound")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    )
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, one of them committed twice.

    Every document is inserted under both tokenizer versions; copies of an
    earlier equal text are deleted; documents with upper-case letters only are
    revised to count nothing; then the first batch is sent again.  The texts are
    read once: digests and counts go to a table that feeds all batches.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    loud = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    read = counts_of(docs).select("doc_id", "source", "lang", "counts", loud.alias("loud"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    read, _ = written(read, "counted")
    items = read.select(F.col("doc_id").alias("item"), "source", "lang", F.inline("counts"))
    rollup.commit("inserts", inserts=items)
    first = read.groupBy("sha").agg(F.min("doc_id").alias("first"))
    seen = read.select("doc_id", "source", "lang", "loud", "sha", F.transform("counts", lambda c: c["tokenizer"]).alias("versions"))
    marked, _ = written(
        salted_lookup(seen, "sha", F.col("doc_id"), first).select(
            F.col("doc_id").alias("item"), "source", "lang", "loud", "versions", (F.col("doc_id") != F.col("first")).alias("copy")
        ),
        "marked",
    )
    both = F.explode("versions").alias("tokenizer")
    rollup.commit("copies", deletes=marked.where("copy").select("item", both))
    revised = marked.where("loud and not copy").select("item", "source", "lang", both).withColumn("tokens", F.lit(0).cast("long"))
    rollup.commit("loud", revisions=revised)
    rollup.commit("inserts", inserts=items)
    return rollup.totals()


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_warc,
        op3_simhash,
        op4_mixing,
        op5_chat_format,
        op6_url_filter,
        op7_language_id,
        op8_nearest_neighbours,
        op9_bpe,
        op10_token_counts,
    )
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
        h AS (SELECT *, sha1(html) AS x FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM h
    """,
    "op6_url_filter": r"""
        WITH RECURSIVE u AS (SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        j AS (SELECT page_id, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad, count(*) AS n
              FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT) AS doc_id FROM u) a
              JOIN labels USING (doc_id) GROUP BY page_id),
        h0 AS (SELECT regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS site, sum(coalesce(n, 0)) AS n, sum(coalesce(bad, 0)) AS bad
               FROM u LEFT JOIN j USING (page_id) GROUP BY site),
        hl AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') OR starts_with(site, '[') AS address FROM h0),
        hn AS (SELECT *, CASE WHEN len(l) > 1 AND regexp_matches(l[-1], '^[a-z]{2}$')
               AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'gouv', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch') THEN 2 ELSE 1 END AS k FROM hl),
        h AS (SELECT site, n, bad, CASE WHEN address THEN site ELSE array_to_string(l[greatest(1, len(l) - k):], '.') END AS domain,
                     CASE WHEN address THEN '' ELSE array_to_string(l[greatest(1, len(l) - k + 1):], '.') END AS suffix FROM hn),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
        s1 AS (SELECT *, (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) FROM s) AS prior FROM s),
        sr AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0) AS rho FROM s1),
        s2 AS (SELECT suffix, (bad + k * prior) / (n + k) AS rate FROM s1, (SELECT 1 / least(greatest(coalesce(rho, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM sr)),
        d1 AS (SELECT d.*, rate AS prior FROM d JOIN s2 USING (suffix)),
        dr AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0) AS rho FROM d1),
        d2 AS (SELECT domain, (bad + k * prior) / (n + k) AS rate FROM d1, (SELECT 1 / least(greatest(coalesce(rho, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM dr)),
        h1 AS (SELECT h.*, rate AS prior FROM h JOIN d2 USING (domain)),
        hr AS (SELECT sum(CASE WHEN n > 1 THEN (bad - n * prior) ** 2 - n * prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 1 THEN n * (n - 1) * prior * (1 - prior) END), 0) AS rho FROM h1),
        h2 AS (SELECT site, n, bad, (bad + k * prior) / (n + k) AS rate, (bad + k * prior)::DOUBLE AS p, (n - bad + k * (1 - prior))::DOUBLE AS q
               FROM h1, (SELECT 1 / least(greatest(coalesce(rho, 1 / 1001.0::DOUBLE), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM hr)),
        t AS (SELECT *, 0.5 > (p + 1) / (p + q + 2) AS turn, CASE WHEN 0.5 > (p + 1) / (p + q + 2) THEN q ELSE p END AS a, CASE WHEN 0.5 > (p + 1) / (p + q + 2) THEN p ELSE q END AS b FROM h2),
        cf AS (SELECT site, a, b, 0 AS m, 1::DOUBLE AS c, 1 / (1 - (a + b) * 0.5 / (a + 1)) AS d, 1 / (1 - (a + b) * 0.5 / (a + 1)) AS f FROM t
               UNION ALL
               SELECT site, a, b, m + 1, c2, d2, f * d1 * c1 * d2 * c2 FROM (
                   SELECT *, 1 / (1 + odd * d1) AS d2, 1 + odd / c1 AS c2 FROM (
                       SELECT *, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
                           SELECT *, (m + 1) * (b - (m + 1)) * 0.5 / ((a + 2 * (m + 1) - 1) * (a + 2 * (m + 1))) AS even,
                                  -(a + m + 1) * (a + b + m + 1) * 0.5 / ((a + 2 * (m + 1)) * (a + 2 * (m + 1) + 1)) AS odd FROM cf WHERE m < 400) x) y) z),
        h3 AS (SELECT t.*, CASE WHEN turn THEN 1 - g ELSE g END AS doubt FROM (SELECT site AS s, exp((a + b) * ln(0.5::DOUBLE) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * f AS g FROM cf WHERE m = 400) w
               JOIN t ON t.site = w.s),
        r AS (SELECT u.*, CASE
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u)
        SELECT page_id, r.host, path, rule,
               CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN doubt <= 0.05 THEN 'block' ELSE 'allow' END AS verdict,
               CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad, round(rate, 9) AS host_rate, round(doubt, 6) AS host_doubt
        FROM r JOIN h3 ON h3.site = regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '')
    """,
    "op4_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
        w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, source_size * 2::DOUBLE AS most FROM s),
        l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, (most / weight, source_size, level)) FROM l WHERE level * weight <= most) * weight, most)) AS target FROM l),
        p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
              coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
        c AS (SELECT *, CAST(least(greatest(budget - epochs * source_size - ahead, 0), size) AS BIGINT) AS part FROM e)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken, source,
               CAST(epochs + CASE WHEN size > 0 AND part = size THEN 1 ELSE 0 END AS INTEGER) AS copies,
               CASE WHEN size > 0 AND part = size THEN 0 ELSE part END AS cut
        FROM c
    """,
    "op5_chat_format": rf"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        opened AS (SELECT conv_id, arg_min(said, (turn, said)) AS opening FROM (SELECT conv_id, turn, sha256(role || chr(10) || text) AS said FROM rows) x GROUP BY conv_id),
        chains AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY opening) / {CHAIN}) AS BIGINT) AS chains FROM opened),
        linked AS (SELECT conv_id, lead(conv_id) OVER (PARTITION BY opening, conv_id % chains ORDER BY conv_id) AS next FROM chains),
        last AS (SELECT conv_id, max(turn) AS last FROM rows WHERE role = 'assistant' GROUP BY conv_id),
        stale AS (SELECT conv_id, arg_max(text, (turn, text)) AS stale FROM rows JOIN last USING (conv_id) WHERE role = 'assistant' AND turn < last GROUP BY conv_id),
        sides AS (
            SELECT conv_id AS pair, 'chosen' AS side, turn, role, text FROM rows
            UNION ALL SELECT l.conv_id, 'rejected', turn, role, text FROM rows r JOIN linked l ON r.conv_id = l.next
            UNION ALL SELECT r.conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn = last THEN coalesce(stale, '') ELSE text END
                FROM rows r JOIN linked l ON r.conv_id = l.conv_id AND l.next IS NULL LEFT JOIN last a ON a.conv_id = r.conv_id LEFT JOIN stale s ON s.conv_id = r.conv_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY turn, role, text) - 1 AS pos FROM sides),
        met AS (SELECT pair, pos, count(DISTINCT role || chr(10) || text) = 1 AND count(*) = 2 AS same FROM placed GROUP BY pair, pos),
        split AS (SELECT pair, coalesce(min(CASE WHEN NOT same THEN pos END), count(*)) AS prompt_turns FROM met GROUP BY pair),
        drawn AS (SELECT p.*, s.prompt_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS r FROM placed p JOIN split s USING (pair)),
        ends AS (SELECT *, sum(CASE WHEN pos >= prompt_turns THEN length(r) ELSE 0 END) OVER (PARTITION BY pair, side ORDER BY pos) AS r_end FROM drawn),
        done AS (SELECT *, CAST(CAST(r_end - length(text) - 11 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r_end AS BIGINT) AS VARCHAR) AS span FROM ends)
        SELECT pair AS conv_id, CAST(any_value(prompt_turns) AS INTEGER) AS prompt_turns,
               sha256(coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos < prompt_turns), '')) AS prompt_sha256,
               sha256(coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos >= prompt_turns), '')) AS chosen_sha256,
               sha256(coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE side = 'rejected' AND pos >= prompt_turns), '')) AS rejected_sha256,
               CAST(coalesce(sum(length(r)) FILTER (WHERE side = 'chosen' AND pos < prompt_turns), 0) AS INTEGER) AS prompt_chars,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos >= prompt_turns AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 'rejected' AND pos >= prompt_turns AND role = 'assistant'), '') AS rejected_mask
        FROM done GROUP BY pair
    """,
    "op10_token_counts": rf"""
        WITH d AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY {_NORMAL} ORDER BY doc_id) AS n FROM documents),
        c AS (SELECT source, lang, 'words@1' AS tokenizer, upper(text) = text AND lower(text) <> text AS loud, {_WORDS} AS tokens FROM d WHERE n = 1
              UNION ALL
              SELECT source, lang, 'bytes@1', upper(text) = text AND lower(text) <> text, octet_length(encode(coalesce(text, ''))) FROM d WHERE n = 1)
        SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS items, CAST(sum(CASE WHEN loud THEN 0 ELSE tokens END) AS BIGINT) AS tokens
        FROM c GROUP BY source, lang, tokenizer
    """,
}
