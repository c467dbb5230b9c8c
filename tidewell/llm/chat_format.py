"""Chat formatting of preference pairs.

A pair has a chosen and a rejected conversation.  Their longest common prefix
of turns is rendered once, as the prompt; what follows on either side is a
completion.  A mask says which characters of a completion are trained on: the
texts of the assistant's turns with their end marks.  All of it is built-in
functions: the two sides meet turn by turn in one aggregation by (pair, turn),
and a pair's turns are gathered only to render them, so a task holds
conversations, never more than its share of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_lookup

# The marks of a rendered turn.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn as text; a null role or text renders as empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(END))


def format_pairs(turns: DataFrame) -> DataFrame:
    """Prompt and masked completions of each pair.

    ``turns`` has pair_id, side (``chosen`` or ``rejected``), turn, role and
    text; other columns are not read.  Turns are ordered by turn, then role and
    text, null turns first.  Returns per pair: pair_id, prompt_turns, prompt,
    chosen, rejected, chosen_mask and rejected_mask.  A mask is a list of
    structs (start, end): character ranges, end exclusive, in its completion.
    Equal sides give two empty completions; a side without turns gives an empty
    prompt and completion.  Repeated turns are turns of their own.  Rows of any
    other side, or of null pair_id, are left out.  An empty table gives an empty
    result.
    """
    rows = turns.where(F.col("side").isin("chosen", "rejected") & F.col("pair_id").isNotNull())
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sides = rows.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")]
    )
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    # The prefix ends at the first turn that differs; a side's length ends it too.
    differing = F.filter(
        F.transform(
            F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))),
            lambda ok, i: F.when(~ok, i),
        ),
        lambda i: i.isNotNull(),
    )
    prefix = F.coalesce(F.try_element_at(differing, F.lit(1)), shorter)
    out = sides.withColumn("prompt_turns", prefix.cast("int"))

    def text_of(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: rendered(t["role"], t["text"])), "")

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("prompt_turns") + 1, F.size(side))

    def mask(part: Column) -> Column:
        head = lambda t: F.length(t["role"]) + F.lit(len(START) + len(MIDDLE))
        body = lambda t: F.length(t["text"]) + F.lit(len(END))
        none = F.array().cast("array<struct<start:int,end:int>>")
        walked = F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda acc, t: F.struct(
                (acc["at"] + head(t) + body(t)).alias("at"),
                F.when(
                    t["role"] == "assistant",
                    F.concat(
                        acc["spans"],
                        F.array(F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + head(t) + body(t)).alias("end"))),
                    ),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
        )
        return walked["spans"]

    return out.select(
        "pair_id",
        "prompt_turns",
        text_of(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        text_of(rest("chosen")).alias("chosen"),
        text_of(rest("rejected")).alias("rejected"),
        mask(rest("chosen")).alias("chosen_mask"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


#: Conversations of one opening turn that are put in order together.
CHAIN = 10_000


def successors(conversations: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(conv_id, next, before) of each conversation: its neighbours, by id, among those of the same opening turn.

    The opening is the first turn's role and text.  Those of one opening form a
    chain, or, if they are more than ``chain``, as many chains by id modulo a
    number that grows with them, so no task orders a hot opening alone.  Only
    ids and digests are moved.
    """
    said = F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", said.alias("said")).alias("t"))
    opened = rows.groupBy("conv_id").agg(F.min("t")["said"].alias("opening"))
    counts = opened.groupBy("opening").agg(F.ceil(F.count("*") / chain).alias("chains"))
    hot = salted_lookup(opened, "opening", F.col("conv_id"), counts.where("chains > 1"), "left")
    link = hot.withColumn("link", F.pmod("conv_id", F.coalesce("chains", F.lit(1))))
    order = Window.partitionBy("opening", "link").orderBy("conv_id")
    return link.select("conv_id", F.lead("conv_id").over(order).alias("next"), F.lag("conv_id").over(order).alias("before"))


def sibling_pairs(conversations: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Pairs made from plain conversations, as input of ``format_pairs``: one pair a conversation.

    Chosen is the conversation.  Rejected is the next one, by id, with the same
    opening turn; for the last of a chain it is the conversation itself with
    its last assistant turn replaced by the assistant's reply before it (empty,
    if there is none): an answer that no longer fits.  Each conversation is
    sent to two pairs at most, however many share an opening.  Rows with a null
    conv_id or turn are left out.  If several rows are the last assistant turn,
    each is replaced.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    talk = Window.partitionBy("conv_id")
    by_assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    rows = rows.withColumn("last", F.max(F.when(by_assistant, F.col("turn"))).over(talk))
    earlier = by_assistant & (F.col("turn") < F.col("last"))
    rows = rows.withColumn("stale", F.max(F.when(earlier, F.struct("turn", "text"))).over(talk)).join(successors(conversations, chain), "conv_id")
    replaced = by_assistant & (F.col("turn") == F.col("last"))
    own = F.when(replaced, F.coalesce(F.col("stale.text"), F.lit(""))).otherwise(F.col("text"))
    side = lambda pair, name, said: F.struct(pair.alias("pair_id"), F.lit(name).alias("side"), said.alias("said"))
    sides = F.array(
        side(F.col("conv_id"), "chosen", F.col("text")),
        side(F.col("before"), "rejected", F.col("text")),
        side(F.when(F.col("next").isNull(), F.col("conv_id")), "rejected", own),
    )
    sent = rows.select("turn", "role", F.inline(F.filter(sides, lambda x: x["pair_id"].isNotNull())))
    return sent.select("pair_id", "side", "turn", "role", F.col("said").alias("text"))
