"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role,
text); adjacent turns of one role form one block; blocks are concatenated.

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

In texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``; a line
feed in a role becomes ``<|nl|>``.  So no text can hold a control string, and
the output reads back to the very turns.  The loss mask covers the assistant's
texts and nothing between them.

Defined results: null text or role counts as empty; a null turn sorts first;
equal rows stay separate turns; rows of a null conversation form one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NEWLINE))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, segments (array of struct<text, loss>), formatted, one row per conversation."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = turns.select(F.col(conv_col).alias("conv_id"), row.alias("_t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))

    def parts(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("_ts"), i - 1)["role"])
        opens = (i == 0) | (before != t["role"])
        head = F.when(opens, F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), _role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"] == learn))

    tail = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("_ts", parts)), tail)
    return packed.select("conv_id", segments.alias("segments")).select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.lit(1), F.size(F.split(formatted, r"<\|im_start\|>"))))

    def turns(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
        body = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def loss_spans(segments: Column) -> Column:
    """array<struct<start, length>> in code points of the formatted text."""
    done = F.aggregate(
        segments,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["text"])).alias("at"),
            F.when(s["loss"], F.array_append(a["spans"], F.struct(a["at"].alias("start"), F.length(s["text"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return done["spans"]
