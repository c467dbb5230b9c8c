"""A corpus pipeline: five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bpe import encoded
from tidewell.llm.common import discard, fresh_path, scratch, small_batches, table
from tidewell.llm.exact_dedup import keep_first
from tidewell.llm.langid import UNKNOWN, predict, train
from tidewell.llm.mixing import repeated
from tidewell.llm.queries import public_vocabulary
from tidewell.llm.simhash import representatives

#: A document goes if its language is unknown or predicted with a lower score.
LEAST_SCORE = 0.3
#: Pre-tokens that a Python worker remembers in each of two generations: an executor's workers share its memory with it.
REMEMBERED = 30_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language go.

    So do null and empty texts and those without a letter.  Null ids don't train.
    """
    small_batches(spark)
    model = train(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))))
    # By place, since columns may have the names that predict adds; each text goes to Python once.
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    known = predict(placed, model, f"c{names.index('text')}").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts the document with the smallest id stays, a null id being the smallest."""
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-deduplication: one document of each component stays.

    Fingerprints of two-word shingles within 10 bits propose, the exact
    similarity of five-word shingles, 0.8 or more, decides.  The smallest id
    stays, a null one being the largest; wordless texts are one component.
    """
    small_batches(spark)
    return representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each source's documents as often as its target weight asks for.

    Null sources are one source, the last; texts without words are left out.
    """
    return repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: each document as token ids, with digests of ids and decoded bytes; null text has none."""
    small_batches(spark)
    return encoded(docs, public_vocabulary(), ids=True, remembered=REMEMBERED).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables go once its result is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            made, before = stage(spark, docs, sf_dir), path
            path = fresh_path(spark, name.replace(" ", "-"), scoped=False)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
