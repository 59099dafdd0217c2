r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example: all turns before it as context, and its reply the only trainable part, given as a span of
code points. A conversation that ends with another role gives one more example, all context, with an empty span, so no turn is lost.

Templates mark a turn as ``begin + head_open + role + head_close + text + end``. Inside roles and texts a backslash is doubled and a control string gets a
backslash after its first character, so no control string of the output comes from a text, and ``unescape`` restores the text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings start with a character that occurs in them once, and hold no backslash."""

    begin: str = "<s>"
    head_open: str = "[INST]"
    head_close: str = "[/INST]"
    end: str = "</s>"

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c or any(c[0] in d[1:] for d in self.controls):
                raise ValueError(f"unfit control string {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.begin, self.head_open, self.head_close, self.end

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in dict.fromkeys(self.controls):
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.begin + self.head_open), self.escape(role), F.lit(self.head_close), self.escape(text), F.lit(self.end))

    def parse(self, formatted: Column) -> Column:
        """The turns of a formatted text, unescaped: ``array<struct<role, text>>``."""
        head = len(self.begin + self.head_open)
        quoted = "".join("\\" + x if not x.isalnum() else x for x in self.end)
        turns = F.filter(F.split(formatted, quoted), lambda x: x != "")

        def one(x: Column) -> Column:
            at = F.instr(x, self.head_close)
            return F.struct(self.unescape(F.substr(x, F.lit(head + 1), at - 1 - head)).alias("role"), self.unescape(F.substr(x, at + len(self.head_close))).alias("text"))

        return F.transform(turns, one)


def expand(conversations: DataFrame, template: Template | None = None, trainable: str = "assistant") -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``(conv_id, example, is_last, text, loss_start, loss_end)``.

    Turns go by turn (null first), then role and text, so ties and repeated rows have one order; all are kept. Null roles and
    texts count as empty; a null conv_id is a conversation of its own. Spans are offsets in code points, end exclusive. Other columns
    are not read; an empty table gives an empty table.
    """
    template = template or Template()
    rows = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    groups = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    size = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (F.get("turns", i - 1)["role"] == trainable) | (i == F.size("turns")))
    groups = groups.select("conv_id", size.alias("n"), F.transform("turns", lambda t: template.turn(t["role"], t["text"])).alias("marked"), F.transform("turns", lambda t: F.when(t["role"] == trainable, F.char_length(template.escape(t["text"])))).alias("target"), ends.alias("ends"))
    rows = groups.select("conv_id", "n", "marked", "target", F.posexplode("ends").alias("example", "upto"))
    rows = rows.select("conv_id", F.col("example").cast("long").alias("example"), (F.col("upto") == F.col("n")).alias("is_last"), F.array_join(F.slice("marked", F.lit(1), F.col("upto")), "").alias("text"), F.get("target", F.col("upto") - 1).alias("target"))
    stop = F.char_length("text") - F.when(F.col("target").isNull(), 0).otherwise(len(template.end))
    return rows.select("conv_id", "example", "is_last", "text", (stop - F.coalesce("target", F.lit(0))).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"))


def read_back(examples: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the formatted examples alone: its turns, its trained texts in order, and the characters formatted.

    ``examples`` are those of ``expand``, each once. A null conv_id is a conversation of its own; without a trainable turn the trained text is empty. Other
    columns are not read; an empty table gives an empty table.
    """
    template = template or Template()
    loss = F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = examples.select("conv_id", "example", F.when(F.col("is_last"), F.col("text")).alias("whole"), F.char_length("text").cast("long").alias("chars"), loss.alias("loss"))
    rows = rows.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("loss"))
    return rows.select("conv_id", template.parse(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: template.unescape(x["loss"])), "").alias("loss"), "formatted_chars")
