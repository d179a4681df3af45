"""Preference formatting.

A pair is two conversations, one chosen and one rejected.  Their longest
common prefix of turns (equal role and text) is rendered once as the prompt;
the turns after it are the two completions.  Each completion comes with its
mask: for every turn the first character, the length and whether it is trained
on (turns of the assistant are).

All of it is DataFrame expressions: turns are gathered by conversation, pairs
meet by their key, and the common prefix is the least place where the two
arrays of turns differ.

`paired_by_id` makes pairs of a plain table of conversations: conversation 2k
is chosen and 2k + 1 rejected.  A preference table with columns pair_id,
chosen_id and rejected_id is formatted by `format_pairs` directly.

Cases: turns are ordered by turn, role and text, nulls first; rows that repeat
turn, role and text are one turn; a null role renders as `unknown`, a null
text as empty, and both are equal to themselves only; a missing conversation
has no turns, so the prompt is empty and its completion is empty; equal
conversations are all prompt; rows with a null conv_id are in no pair; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
HEAD, SEP, TAIL = "<|", "|>\n", "\n"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (role, text)."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", "text").alias("x"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return lists.select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("unknown")), F.lit(SEP), F.coalesce(turn["text"], F.lit("")), F.lit(TAIL))


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns at the beginning of both."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(F.slice(same, F.lit(1), F.greatest(shorter, F.lit(0))), False)
    return F.when(differs == 0, shorter).otherwise((differs - 1).cast("int"))


def completion(turns_: Column, skip: Column) -> tuple[Column, Column]:
    """The text of the turns after the prompt, and their mask."""
    rest = F.slice(turns_, skip + 1, F.greatest(F.size(turns_) - skip, F.lit(0)))
    texts = F.transform(rest, rendered)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,train:boolean>>").alias("mask"))

    def step(state, turn):
        n = F.length(rendered(turn))
        span = F.struct(state["at"].alias("start"), n.alias("length"), F.coalesce(turn["role"] == "assistant", F.lit(False)).alias("train"))
        return F.struct((state["at"] + n).alias("at"), F.concat(state["mask"], F.array(span)).alias("mask"))

    return F.array_join(texts, ""), F.aggregate(rest, start, step, lambda s: s["mask"])


def paired_by_id(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen_id and rejected_id: conversations 2k and 2k + 1 of each k that has one."""
    ids = conversations.where("conv_id IS NOT NULL").select(F.expr("conv_id - pmod(conv_id, 2)").alias("chosen_id")).distinct()
    return ids.select(F.expr("chosen_id div 2").alias("pair_id"), "chosen_id", (F.col("chosen_id") + 1).alias("rejected_id"))


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected and the masks of both."""
    own = turns(conversations)
    none = F.array().cast(own.schema["turns"].dataType)
    left = own.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = own.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(left, "chosen_id", "left").join(right, "rejected_id", "left")
    both = both.withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    both = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    (chosen, chosen_mask), (rejected, rejected_mask) = completion(F.col("a"), F.col("n")), completion(F.col("b"), F.col("n"))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_common"),
        F.array_join(F.transform(F.slice("a", F.lit(1), F.col("n")), rendered), "").alias("prompt"),
        chosen.alias("chosen"),
        rejected.alias("rejected"),
        chosen_mask.alias("chosen_mask"),
        rejected_mask.alias("rejected_mask"),
    )


ORACLE = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM u),
p AS (SELECT DISTINCT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, conv_id - ((conv_id % 2) + 2) % 2 AS chosen_id FROM u),
o2 AS (SELECT conv_id, k, coalesce(role, 'unknown') AS role, coalesce(role = 'assistant', false) AS train, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS r FROM o),
f AS (
  SELECT p.pair_id, p.chosen_id, o2.conv_id, o2.k, o2.r, o2.train,
    coalesce((SELECT min(x.k) FROM o x LEFT JOIN o y ON y.conv_id = p.chosen_id + 1 AND y.k = x.k WHERE x.conv_id = p.chosen_id AND (y.k IS NULL OR x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text)),
             (SELECT max(k) + 1 FROM o x WHERE x.conv_id = p.chosen_id), 1) AS first
  FROM p LEFT JOIN o2 ON o2.conv_id IN (p.chosen_id, p.chosen_id + 1)
)
SELECT pair_id, chosen_id, chosen_id + 1 AS rejected_id, CAST(first - 1 AS BIGINT) AS n_common,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE conv_id = chosen_id AND k < first), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE conv_id = chosen_id AND k >= first), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE conv_id = chosen_id + 1 AND k >= first), '') AS rejected,
  coalesce(string_agg(length(r) || CASE WHEN train THEN '+' ELSE '-' END, ',' ORDER BY k) FILTER (WHERE conv_id = chosen_id AND k >= first), '') AS chosen_mask,
  coalesce(string_agg(length(r) || CASE WHEN train THEN '+' ELSE '-' END, ',' ORDER BY k) FILTER (WHERE conv_id = chosen_id + 1 AND k >= first), '') AS rejected_mask
FROM f GROUP BY pair_id, chosen_id, first
"""
