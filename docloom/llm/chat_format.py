"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and only that
reply under the loss mask. Turns after the last reply, and conversations without any reply, become
one last example with an empty mask, so that no turn is lost.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is
doubled and ``<|`` is written ``<\\|``; a line break inside a role is written ``<\\n|``. As literal
backslashes are doubled, a single backslash between ``<`` and ``|`` occurs only where it was put, so
the reverse is two plain replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Finds the turns of a formatted text: group 1 the role, group 2 the text.
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n|"), F.lit("\n")))


def prefix_targets(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, turn_index, formatted, loss_start, loss_length: one row for each reply.

    loss_start (from 0) and loss_length count code points of ``formatted``; loss_length is 0 where
    the mask is empty and loss_start is null there. Rows of a conversation are put in order of turn,
    then role, then text (nulls first), so ties and repeated rows have one result; repeated rows stay.
    A null role or text is an empty one; a null conv_id is a conversation of its own; no rows give
    none. Other columns are not read. The size of the output is by definition quadratic in the
    number of a conversation's turns; one conversation's turns must fit into a task.
    """
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    who = F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.col("role").alias("role"),
            F.col("text").alias("text"),
            (who == target_role).alias("target"),
            F.concat(F.lit(OPEN), escape_role(who), F.lit("\n")).alias("head"),
            body.alias("body"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: F.element_at("ts", i)["target"] | (i == F.size("ts")),
    )
    each = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(f"{CLOSE}\n"))).alias("said"),
        "ts",
        F.explode(ends).alias("turn_index"),
    )
    last = F.element_at("ts", F.col("turn_index"))
    formatted = F.array_join(F.slice("said", F.lit(1), F.col("turn_index")), "")
    return each.select(
        "conv_id",
        "turn_index",
        formatted.alias("formatted"),
        F.when(last["target"], F.length(F.array_join(F.slice("said", F.lit(1), F.col("turn_index") - 1), "")) + F.length(last["head"])).alias("loss_start"),
        F.when(last["target"], F.length(last["body"])).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation say, read from them alone."""
    masked = unescape(F.when(F.col("loss_start").isNotNull(), F.expr("substring(formatted, loss_start + 1, loss_length)")).otherwise(F.lit("")))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "turn_index").alias("longest"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("turn_index", masked.alias("text")))), lambda x: x["text"])).alias("loss"),
    )
    roles = F.regexp_extract_all("longest", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("longest", F.lit(TURN), F.lit(2))
    said = F.zip_with(roles, texts, lambda r, t: F.concat(unescape_role(r), F.lit("\n"), unescape(t), F.lit("\n")))
    return whole.select(
        "conv_id",
        F.size(roles).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
