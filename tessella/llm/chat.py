"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings. Each begins with < or [, which escaped texts never hold.
OPEN, BODY, CLOSE, NEXT, START = "[ROLE ", "]\n", "<END>\n", "<NEXT>", "<BEGIN>\n"
LEARN = "assistant"


def escape(text: Column) -> Column:
    """Reversible: back-slash, < and [ become two characters, so no control string is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\k"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As texts, and the bracket that ends a role's name."""
    return F.replace(escape(role), F.lit("]"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit("]")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted.

    Turns stand by turn number, then role, then text (nulls first in each); adjacent turns of one
    role form one block, parted by a control string, so the format can be read back turn by turn.
    A null text or role is empty; repeated rows are turns of their own; rows with a null conversation id form
    one conversation; an empty table gives no rows; other columns are not read.

    The turns of a conversation are one output value, so they must meet in one row: its size
    is the conversation's own. Only the struct that is sorted travels.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    # a turn opens a block unless the one before has its role
    marked = F.transform(
        F.col("turns"),
        lambda t, i: F.concat(
            F.when((i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"]), F.lit(NEXT)).otherwise(
                F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape_role(t["role"]), F.lit(BODY))
            ),
            escape(t["text"]),
        ),
    )
    return sorted_turns.select("conv_id", F.concat(F.lit(START), F.array_join(marked, ""), F.lit(CLOSE)).alias("formatted"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Back from ``formatted`` to conv_id, formatted, turns (role, text in order) and learned, the text under the loss mask."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START)})")
    blocks = F.filter(F.split(inner, "<END>\n", -1), lambda b: b != "")
    parts = F.transform(
        blocks,
        lambda b: F.struct(
            F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "]\n", 1).alias("role"),
            F.substr(b, F.lit(len(OPEN) + len(BODY) + 1) + F.length(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "]\n", 1))).alias("body"),
        ),
    )
    turns = F.flatten(F.transform(parts, lambda p: F.transform(F.split(p["body"], "<NEXT>", -1), lambda x: F.struct(unescape_role(p["role"]).alias("role"), unescape(x).alias("text")))))
    out = chats.select("conv_id", "formatted", turns.alias("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARN), lambda t: t["text"]), "")
    return out.withColumn("learned", learned)
