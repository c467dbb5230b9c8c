"""Token counts: rollups maintained by signed deltas, committed in batches.

A batch is a table of events on items: ``insert``, ``delete`` or ``revise`` of an
item's count under one tokenizer version.  Committing turns each event into
signed rows (an insert is +1 item, +n tokens; a delete takes back what the
ledger holds for the item; a revision takes that back and adds the new count)
and sums them up to one delta a source, language and tokenizer version.  Totals
add the deltas, a few rows a batch, and never read the items again;
``compact`` folds the deltas so far into one base.

A batch is written under a name of its own and becomes part of the rollup when
its marker is renamed to the batch's id, which fails if another has that id.  A
batch that is committed again changes nothing, of two writers of one batch one
wins, and one that died half way left nothing that is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, encoded
from .common import file_system, discard, word_count

DIMS = ("source", "lang", "tokenizer")

#: Tokenizer versions that need no Python: expressions over the text.
TOKENIZERS = {
    "words@1": lambda text: word_count(text),
    "bytes@1": lambda text: F.octet_length(F.coalesce(text, F.lit(""))).cast("long"),
}

LEDGER = "item long, source string, lang string, tokenizer string, items long, tokens long"
DELTAS = "source string, lang string, tokenizer string, items long, tokens long"


def counts_of(docs: DataFrame, versions=("words@1", "bytes@1"), vocabularies: dict[str, Vocabulary] | None = None) -> DataFrame:
    """``docs`` with a column ``counts``, by one pass over ``text``: an array of (tokenizer, tokens).

    ``vocabularies`` adds versions that the byte-level BPE encoder counts.  Null text is empty.
    """
    made, names = docs, []
    for version, vocabulary in (vocabularies or {}).items():
        packed = made.select(F.struct(*made.columns).alias("_row"), "text")
        names.append(f"_n{len(names)}")
        made = encoded(packed, vocabulary).select("_row.*", F.col("n_tokens").alias(names[-1]))
    each = [F.struct(F.lit(v).alias("tokenizer"), TOKENIZERS[v](F.col("text")).alias("tokens")) for v in versions]
    each += [F.struct(F.lit(v).alias("tokenizer"), F.col(n).alias("tokens")) for v, n in zip(vocabularies or {}, names, strict=True)]
    return made.select(*docs.columns, F.array(*each).alias("counts"))


def counted(docs: DataFrame, versions=("words@1", "bytes@1"), id_col: str = "doc_id", vocabularies: dict[str, Vocabulary] | None = None) -> DataFrame:
    """One row per document and tokenizer version: item, source, lang, tokenizer, tokens."""
    slim = docs.select(F.col(id_col).alias("item"), "source", "lang", "text")
    return counts_of(slim, versions, vocabularies).select("item", "source", "lang", F.inline("counts"))


class Rollup:
    """Totals by source, language and tokenizer version in a shared folder.

    Items are identified by (item, tokenizer).  Null sources and languages are
    groups of their own; events with a null item or a null count are counted as
    an item and as 0 tokens.  Deletes and revisions of items that the rollup
    doesn't hold add nothing for the part taken back.  Within a batch, inserts
    come first, then deletes, then revisions; an item's events must be at most
    one delete or revision; repeated inserts add up.  An empty batch is
    committed as empty.  Two batches that change the same items must not be
    committed at the same time, as each takes back what it finds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, kind: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _markers(self, kind: str) -> list[dict]:
        """Contents of the markers, each one line of JSON."""
        if not self._listed(kind):
            return []
        return [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/{kind}").collect()]

    def _publish(self, kind: str, name: str, content: dict) -> bool:
        """Rename a finished marker to its name; False if that is taken.  The rename never overwrites."""
        jvm = self.spark.sparkContext._jvm
        made, final = f"{self.path}/trials/{uuid.uuid4().hex}", f"{self.path}/{kind}/{name}"
        fs, at = file_system(self.spark, made)
        out = fs.create(at, False)
        out.write(bytearray((json.dumps(content) + "\n").encode()))
        out.close()
        _, to = file_system(self.spark, final)
        fs.mkdirs(to.getParent())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(at, to, never)
        except Exception as e:
            fs.delete(at, True)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def committed(self) -> list[str]:
        """Ids of the committed batches; there is one entry a batch, whatever its size."""
        return self._listed("commits")

    def _read(self, trials: list[str], part: str, schema: str) -> DataFrame:
        if not trials:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{t}/{part}" for t in trials])

    def ledger(self) -> DataFrame:
        """All committed signed rows."""
        return self._read([m["trial"] for m in self._markers("commits")], "rows", LEDGER)

    def deltas(self) -> DataFrame:
        """What ``totals`` adds up: the newest base, and the deltas of the batches that it doesn't hold."""
        trials = [m["trial"] for m in self._markers("commits")]
        base = max(self._markers("bases"), key=lambda m: len(m["holds"]), default={"holds": []})
        own = self._read(sorted(set(trials) - set(base["holds"])), "deltas", DELTAS)
        return own.unionByName(self._read([base["trial"]], "deltas", DELTAS)) if "trial" in base else own

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit a batch; False if a batch of this id was committed before.

        ``inserts`` and ``revisions`` have item, source, lang, tokenizer, tokens;
        ``deletes`` has item and tokenizer.  The rows are written sorted by item,
        so that the lookup of a later batch reads the range of its items only.
        """
        if not batch_id or "/" in batch_id or batch_id[0] in "._":
            raise ValueError("a batch id must be a plain name")
        if batch_id in self.committed():
            return False
        gone = [x.select("item", "tokenizer") for x in (deletes, revisions) if x is not None]
        keys = gone[0].unionByName(gone[1]) if len(gone) == 2 else gone[0] if gone else None
        rows = [self.spark.createDataFrame([], LEDGER)]
        for added in (inserts, revisions):
            if added is not None:
                if added is inserts and keys is not None:
                    added = added.join(keys, ["item", "tokenizer"], "left_anti")
                rows.append(added.select("item", *DIMS, F.lit(1).cast("long").alias("items"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
        if keys is not None and self.committed():
            ends = keys.agg(F.min("item").alias("low"), F.max("item").alias("high")).first()
            if ends["low"] is not None:
                near = self.ledger().where(F.col("item").between(ends["low"], ends["high"]))
                held = near.join(keys, ["item", "tokenizer"], "left_semi")
                rows.append(
                    held.groupBy("item", *DIMS).agg((-F.sum("items")).alias("items"), (-F.sum("tokens")).alias("tokens")).where("items != 0 or tokens != 0")
                )
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        trial = uuid.uuid4().hex
        out.sortWithinPartitions("item").write.parquet(f"{self.path}/data/{trial}/rows")
        return self._finish("commits", batch_id, trial, self._read([trial], "rows", LEDGER), {})

    def _finish(self, kind: str, name: str, trial: str, rows: DataFrame, more: dict) -> bool:
        self._summed(rows).coalesce(1).write.parquet(f"{self.path}/data/{trial}/deltas")
        if self._publish(kind, name, {"trial": trial, **more}):
            return True
        discard(self.spark, f"{self.path}/data/{trial}")  # another writer was first
        return False

    def compact(self) -> bool:
        """Fold the deltas of all batches so far into one base; False if another did so meanwhile."""
        holds = sorted(m["trial"] for m in self._markers("commits"))
        return self._finish("bases", f"{len(holds):012d}", uuid.uuid4().hex, self.deltas(), {"holds": holds})

    def _summed(self, rows: DataFrame) -> DataFrame:
        summed = rows.groupBy(*DIMS).agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
        return summed.where("items != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, items, tokens; groups that are empty again are left out."""
        return self._summed(self.deltas())
