"""Preference formatting of chat data.

A pair of conversations, one chosen and one rejected, shares a prefix of equal turns.  The prefix is rendered once as the prompt; what follows is
rendered for each side as a completion.  Masks mark the characters a model is trained on: the turns of the assistant in a
completion, nothing of the prompt, and no role markers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Text around a turn; {role} stands for its role."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    trained_role: str = "assistant"


CHATML = Template("<|im_start|>{role}\n", "<|im_end|>\n")
PLAIN = Template()


def _head(turn: Column, t: Template) -> Column:
    return F.replace(F.lit(t.before), F.lit("{role}"), turn["role"])


def render(turns: Column, t: Template) -> Column:
    """One text for an array of turns(role, text)."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x, t), x["text"], F.lit(t.after))), "")


def spans(turns: Column, t: Template) -> Column:
    """Character ranges (start, end) of the rendered text that are trained on: text and end marker of the trained role."""
    step = F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(_head(x, t)) + F.length(x["text"]) + len(t.after)).alias("at"),
            F.when(x["role"] == t.trained_role, F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(_head(x, t))).cast("int").alias("start"),
                (a["at"] + F.length(_head(x, t)) + F.length(x["text"]) + len(t.after)).cast("int").alias("end"))))).otherwise(a["out"]).alias("out")))
    return step["out"]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, turns(role, text) in the order of `turn` (null first; ties by role and text).

    A null role or text counts as empty; repeated rows are one turn.  A conversation is the unit of this operator and fits in a row.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    listed = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    differ = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i == F.least(F.size(a), F.size(b))))
    return F.get(differ, F.lit(0)).cast("int")


def format_preferences(pairs: DataFrame, template: Template = CHATML) -> DataFrame:
    """`pairs(..., chosen, rejected)` of turn arrays -> the other columns, n_shared, prompt, both completions and their spans.

    The spans of a completion count from its own start.  When one side is a prefix of the other its completion is empty; equal sides
    have two empty completions, which the caller may drop.  Null arrays count as empty.
    """
    none = F.array().cast(pairs.schema["chosen"].dataType)
    p = pairs.withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none))
    p = p.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(s, F.col("n_shared") + 1, F.size(s)) for s in ("chosen", "rejected")}
    p = p.withColumn("prompt", render(F.slice("chosen", 1, F.col("n_shared")), template))
    for s, tail in rest.items():
        p = p.withColumn(f"{s}_completion", F.when(F.size(s) > F.col("n_shared"), render(tail, template)).otherwise(""))
        p = p.withColumn(f"{s}_spans", F.when(F.size(s) > F.col("n_shared"), spans(tail, template)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    return p.drop("chosen", "rejected")


def preference_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(pair_id, kind, chosen, rejected) from plain conversations, which carry no preferences of their own.

    Every conversation with a trained turn after another turn is chosen over two worse versions of itself: `truncated` stops before
    its last trained turn is complete (the first half of that text), `repeated` answers with the first trained text again (where there
    is an earlier one), so the longest common prefix is everything before the last trained turn.
    """
    c = conversations(turns)
    at = F.array_max(F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == trained_role, i)), lambda i: i.isNotNull()))
    first = F.array_min(F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == trained_role, i)), lambda i: i.isNotNull()))
    c = c.withColumn("at", at).withColumn("first", first).filter("at > 0")

    def version(kind: str, text: Column) -> Column:
        last = F.array(F.struct(F.lit(trained_role).alias("role"), text.alias("text")))
        return F.struct(F.lit(kind).alias("kind"), F.concat(F.slice("turns", 1, F.col("at")), last).alias("rejected"))

    final = F.get("turns", F.col("at"))["text"]
    worse = F.array(version("truncated", F.left(final, F.floor(F.length(final) / 2).cast("int"))),
                    version("repeated", F.get("turns", F.col("first"))["text"]))
    out = c.select("conv_id", F.slice("turns", 1, F.col("at") + 1).alias("chosen"), "at", "first", F.explode(worse).alias("w"))
    return (out.filter("w.kind = 'truncated' or first < at").filter(F.col("chosen") != F.col("w.rejected"))
            .select(F.col("conv_id").alias("pair_id"), "w.kind", "chosen", "w.rejected"))
