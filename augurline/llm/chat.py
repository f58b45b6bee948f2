"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its reply is trainable.  A
conversation that doesn't end with an assistant turn gets one more example, of all its turns and without a trainable part, so that
no turn is lost.

A turn reads ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``
(line ends in roles ``&#10;``), so no text can contain a control string, and the replacement can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def examples(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example (from 0), formatted, loss_start (0-based), loss_chars (0: no trainable part).

    Turns are ordered by turn, then role and text where turns tie, null first; repeated rows are turns of their own.  Null roles and
    texts are empty; rows with a null conversation id form one conversation.  Other columns are ignored.  The turns of a conversation
    meet in one row, because each example is one string of them.
    """
    said = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    grouped = said.groupBy("conv").agg(F.array_sort(F.collect_list("said")).alias("said"))
    formatted = F.transform(
        "said",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("trained"),
            F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
        ),
    )
    marked = grouped.select("conv", formatted.alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("turns", i)["trained"] | (i == n - 1))
    single = marked.select("conv", "turns", F.posexplode(ends).alias("example", "last"))
    whole = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("last") + 1), lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    reply = F.get("turns", F.col("last"))
    single = single.select("conv", "example", whole.alias("formatted"), reply["trained"].alias("trained"), F.char_length(reply["body"]).alias("reply"))
    return single.select(
        F.col("conv").alias(conv),
        "example",
        "formatted",
        F.when(F.col("trained"), F.char_length("formatted") - F.col("reply") - len(END) - 1).otherwise(0).alias("loss_start"),
        F.when(F.col("trained"), F.col("reply")).otherwise(0).alias("loss_chars"),
        "trained",
    )


def digests(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """What the examples say, read back from their strings: turns of the last example, texts under the loss mask of all."""
    loss = F.struct("example", unescaped(F.expr("substring(formatted, loss_start + 1, loss_chars)")).alias("loss"))
    per = formatted.groupBy(F.col(conv)).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), loss))).alias("losses"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    parts = F.filter(F.split("longest", r"<\|im_start\|>"), lambda _, i: i > 0)
    turns = F.transform(
        parts,
        lambda p: F.concat(
            unescaped_role(F.substring_index(p, "\n", 1)),
            F.lit("\n"),
            unescaped(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 2 - len(END))),
            F.lit("\n"),
        ),
    )
    masked = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per.select(
        conv,
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
