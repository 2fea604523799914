"""Operator 5: chat formatting by prefix-target expansion, DataFrame functions only.

A conversation is formatted once. Each assistant turn then becomes an example of its own: its
context is the formatted conversation up to and with the turn's head, its target the turn's
text and end mark, and only the text is trainable. An example has its target's text and its context
as a span of the formatted conversation, so the output grows with the input and not with the square
of a conversation's length; `example_texts` writes contexts out.

The template: a turn is `<|role|>` NEWLINE text `<|end|>` NEWLINE. In texts and roles
backslash, `<` and `[` are escaped, so neither these marks nor other templates' control strings
(`</s>`, `[INST]`) can come from a text, and `unescape` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a character in escaped texts; backslash first.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
END = "<|end|>\n"
BLOCK = 4096  #: code points of a formatted conversation that are looked through for an example's start


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn of turns(conv_id, turn, role, text) as its part of the formatted conversation.

    Columns conv_id, turn_number (from 0), role, part (formatted), start (of the part), text_start
    and text_chars (of the escaped text), all in code points of the formatted conversation, and
    trainable. Turns are in the order of turn, null first, ties by role and text. Null roles and
    texts are empty; a null conv_id is a conversation like others; repeated rows are turns of
    their own. Other columns are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # "|>" cannot end a head early: ">" of a role is escaped as well
    head = F.concat(F.lit("<|"), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit("|>\n"))
    rows = rows.withColumns({"head": head, "coded": escape(F.col("text"))})
    rows = rows.withColumn("part", F.concat("head", "coded", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumns({"turn_number": (F.row_number().over(order) - 1).cast("long"), "start": F.coalesce(before, F.lit(0)).cast("long")})
    return placed.select(
        "conv_id", "turn_number", "role", "part", "start",
        (F.col("start") + F.length("head")).alias("text_start"),
        F.length("coded").cast("long").alias("text_chars"),
        (F.col("role") == "assistant").alias("trainable"),
    )


def expanded(formatted: DataFrame) -> DataFrame:
    """Prefix-target expansion of format_turns: a row for each turn and one more for each example.

    Columns conv_id, turn_number, part (the turn, null in examples), context_end and target (null in
    turns). An example's context is the formatted conversation before context_end, its target the
    formatted text of the turn with the end mark, of which all but the mark is trainable.
    """
    target = F.substring("part", (F.col("text_start") - F.col("start") + 1).cast("int"), F.length("part"))
    turn = F.struct(F.col("part").alias("part"), F.lit(None).cast("long").alias("context_end"), F.lit(None).cast("string").alias("target"))
    example = F.struct(F.lit(None).cast("string").alias("part"), F.col("text_start").alias("context_end"), target.alias("target"))
    each = F.explode(F.when(F.col("trainable"), F.array(turn, example)).otherwise(F.array(turn)))
    return formatted.select("conv_id", "turn_number", each.alias("e")).select("conv_id", "turn_number", "e.*")


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, turn_number, context_end, target (see expanded)."""
    return expanded(formatted).where("target is not null").drop("part")


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted (text), examples (turn_number, context_end, target; in order) of expanded rows.

    A conversation is a row: it must fit one, as a digest of it has to.
    """
    part = F.when(F.col("part").isNotNull(), F.struct("turn_number", "part"))
    example = F.when(F.col("target").isNotNull(), F.struct("turn_number", "context_end", "target"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.array_sort(F.collect_list(example)).alias("examples"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "examples")


def example_texts(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), context, target: the examples written out, the target with its end mark."""
    whole = conversations(expanded(format_turns(turns)))
    each = whole.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    return each.select("conv_id", "example", F.substring("formatted", F.lit(1), F.col("e.context_end").cast("int")).alias("context"), "e.target")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>\n")
    heads = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate("|>\n", p)
        role = unescape(F.replace(F.substring(p, F.lit(3), at - 3), F.lit("\\g"), F.lit(">")))
        return F.struct(role.alias("role"), unescape(F.substring(p, at + 3, F.length(p))).alias("text"))

    return F.transform(heads, turn)


def _trained(formatted: Column, examples: Column) -> Column:
    """The trainable text of each example, unescaped, read from the formatted conversation at the end of its context.

    The conversation is cut into blocks once and an example reads those that it touches, so the work
    grows with the text and not with the square of the turns.
    """

    def read(blocks: Column) -> Column:
        def one(e: Column) -> Column:
            chars = F.length(e["target"]) - len(END)
            first = F.floor(e["context_end"] / BLOCK).cast("int")
            last = F.floor((e["context_end"] + chars) / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return unescape(F.substring(near, (e["context_end"] % BLOCK).cast("int") + 1, chars))

        return F.transform(examples, one)

    cut = F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.get(F.transform(F.array(cut), read), F.lit(0))  # a lambda's argument is computed once


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations say of their turns, and under the loss masks of their examples, one row a conversation."""
    whole = conversations(expanded(format_turns(turns)))
    said = whole.select("conv_id", "formatted", "examples", turns_of(F.col("formatted")).alias("turns"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(_trained(F.col("formatted"), F.col("examples")), "")
    return said.select("conv_id", "formatted", "turns", all_turns.alias("all"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode("all", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
