r"""Chat formatting by prefix-target expansion. DataFrame operations only.

Every assistant turn becomes an example of its own: all turns up to it are the text, and the
loss span covers that reply alone. A conversation that doesn't end with an assistant turn gets
one more example, of all its turns, with an empty span, so no turn is lost.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts a backslash becomes
two and ``<|`` becomes ``<\|``; in roles a line break becomes ``\n``. So the marks can't occur
inside a turn, and ``unescape`` gives the texts back.

Defined cases: null roles and texts are empty strings; rows of a conversation are ordered by
turn, then role and text (null turns first); repeated rows are turns of their own; rows without
conv_id form one conversation; very long texts are kept whole (a conversation's text is one value, at
most 2 GB); an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?s)\G((?:[^\\]|\\[^n])*+)\\n", "$1\n"))


def examples(turns: DataFrame, together: int = 64) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end (code points; equal: no target).

    Where each turn ends in its conversation is a running sum, the conversation's text is put together once, and an
    example is a prefix of it. The examples of a long conversation are dealt out ``together`` at a time, so that their
    texts, which grow with the square of its turns, are no single task's work.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    within = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = clean.select("*", body.alias("body")).select(
        "conv_id",
        "body",
        (F.row_number().over(within) - 1).alias("pos"),
        F.sum(F.length("body").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.length(escape(F.col("text"))).alias("chars"),
        (F.col("role") == "assistant").alias("target"),
        F.lead(F.lit(1)).over(within).isNull().alias("last"),
    )
    span = F.when(F.col("target") | F.col("last"), F.struct("pos", "upto", F.when(F.col("target"), F.col("chars")).otherwise(0).alias("chars")))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"), F.sort_array(F.collect_list(span)).alias("spans"))
    whole = grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("whole"), "spans")
    dealt = whole.where(F.size("spans") > together).select("conv_id", "whole", "spans", F.explode(F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / together).cast("int"))).alias("deal"))
    dealt = dealt.select("conv_id", "whole", F.slice("spans", F.col("deal") * together + 1, F.lit(together)).alias("spans"), "deal").repartition("conv_id", "deal").drop("deal")
    each = whole.where(F.size("spans") <= together).unionByName(dealt).select("conv_id", "whole", F.explode("spans").alias("span"))
    end = F.col("span.upto") - len(END)
    return each.select(
        "conv_id",
        F.col("span.pos").alias("example"),
        (F.col("span.pos") + 1).cast("long").alias("n_turns"),
        F.substr("whole", F.lit(1), F.col("span.upto").cast("int")).alias("text"),
        (end - F.col("span.chars")).alias("loss_start"),
        end.alias("loss_end"),
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    bodies = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        rest = F.substr(body, F.length(role) + 2, F.length(body) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(bodies, turn)


def digest(written: DataFrame) -> DataFrame:
    """What the examples say of each conversation, parsed from their texts and spans."""
    target = unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    each = written.select("conv_id", "example", "text", target.alias("target"))
    grouped = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "target"))).alias("targets"), F.max_by("text", "example").alias("text"), F.sum(F.length("text")).alias("formatted_chars"))
    turns = grouped.select("conv_id", parse(F.col("text")).alias("turns"), F.array_join(F.transform("targets", lambda t: t["target"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
