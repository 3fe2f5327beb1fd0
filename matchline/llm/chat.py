"""Chat formatting: one training example per assistant turn, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN_END = END + "\n"


def escape(text: Column) -> Column:
    """No control string is left: a backslash is doubled, then `<|` becomes `<\\|`."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo `escape`; a single backslash after `<` cannot come from anything else."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    """Roles end at a line end, so theirs are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_turns(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _escape_role(role), F.lit("\n"), escape(text), F.lit(_TURN_END))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Examples (conv, example, n_turns, text, loss_start, loss_end): `text` is the formatted context and reply, and the code points from
    loss_start up to loss_end, counted from 0, are the reply's text, the only trainable part.

    Every turn of the role `trained` makes an example. Turns after the last one make a final example with nothing trainable, so each
    conversation can be read back in full. NULL texts and roles are empty. Turns order by `turn`, ties and repeated rows by role and
    text, NULL first; a NULL `conv` is a conversation of its own. Other columns are not read.

    A conversation is one record: its turns meet in one row, and its examples hold its prefixes, as the method wants.
    """
    own = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = own.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    formatted = whole.select("conv", "turns", F.transform("turns", lambda t: format_turns(t["role"], t["text"])).alias("parts"))
    numbered = formatted.select("conv", "turns", "parts", F.size("parts").alias("n"), F.posexplode("turns").alias("i", "t"))
    is_trained = F.col("t.role") == trained
    chosen = numbered.where(is_trained | (F.col("i") == F.col("n") - 1))
    example = chosen.select(
        "conv", F.col("i").alias("example"), F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "").alias("text"),
        F.when(is_trained, F.char_length(escape(F.col("t.text")))).otherwise(0).cast("long").alias("n_loss"), (F.col("i") + 1).cast("long").alias("n_turns"),
    )
    loss_end = F.char_length("text").cast("long") - len(_TURN_END)
    return example.select(F.col("conv").alias(conv), "example", "n_turns", "text", (loss_end - F.col("n_loss")).alias("loss_start"), loss_end.alias("loss_end"))


def loss_text(text: str = "text") -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(F.col(text), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))


def read_turns(text: Column) -> Column:
    """Formatted text back to an array of (role, text)."""
    parts = F.split(text, "\\Q" + _TURN_END + "\\E")
    head = F.length(F.lit(START))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rest = F.transform(turns, lambda p: F.substring(p, head + 1, F.length(p)))
    return F.transform(rest, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text")))
