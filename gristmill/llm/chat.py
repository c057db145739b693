"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its text alone is under the loss mask [loss_start, loss_end) of
code points of `formatted`. Turns after the last assistant turn end in a last
example whose mask is empty, so the output holds every turn.

A turn is  <|im_start|>role NEWLINE text<|im_end|>NEWLINE . Inside texts and
roles each control string gets a backslash behind its first character, and one
that has backslashes there gets one more, so unescaping (one less) is exact. A
backslash or line feed in a role is written \\\\ or \\n.

Turns of a conversation are ordered by turn, role and text, so ties have an
order; null texts and roles are empty; a null turn comes first; rows without
conv_id form one conversation. Repeated rows are turns of their own. An empty
table gives no examples. Other columns are ignored. An example is one row, so a
conversation's turns meet in one task; conversations don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers, and the control strings of public templates that texts can't be allowed to say.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"(\|im_start\|>|\|im_end\|>|/s>|s>|INST\]|/INST\])"
PLAIN = r"([<\[])(\\*)" + CONTROL
ESCAPED = r"([<\[])\\(\\*)" + CONTROL


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    one = F.replace(unescaped(role), F.lit("\\\\"), F.lit("\\\r"))
    return F.replace(F.replace(one, F.lit("\\n"), F.lit("\n")), F.lit("\\\r"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end of conv_id, turn, role, text."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END)).alias("all"), F.length(escaped(t["text"])).alias("n")))
    turns = turns.select("conv_id", made.alias("made"))
    last = F.size("made") - 1
    turns = turns.select("conv_id", "made", F.explode(F.filter(F.sequence(F.lit(0), last), lambda i: F.get("made", i)["reply"] | (i == last))).alias("at"))
    formatted = F.array_join(F.transform(F.slice("made", F.lit(1), F.col("at") + 1), lambda m: m["all"]), "")
    end = F.length("formatted") - len(END)
    return turns.select("conv_id", F.col("at").alias("example"), formatted.alias("formatted"), F.get("made", F.col("at")).alias("m")).select(
        "conv_id", "example", "formatted", (end - F.when(F.col("m.reply"), F.col("m.n")).otherwise(0)).alias("loss_start"), end.alias("loss_end")
    )


def loss_text(example: str = "") -> Column:
    """The text under the mask, unescaped."""
    return unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def turns_of(formatted: Column) -> Column:
    """Array of role, text that a formatted string holds."""
    parts = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda p: p != "")

    def back(p: Column) -> Column:
        p = F.substr(p, F.lit(len(START) + 1))
        at = F.locate("\n", p)
        return F.struct(_role_back(F.substr(p, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(p, at + 1)).alias("text"))

    return F.transform(parts, back)


def conversations_back(made: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss (array of masked texts, in order), formatted_chars from examples()."""
    return made.withColumn("loss", F.struct("example", F.when(F.col("loss_end") > F.col("loss_start"), loss_text()).otherwise("").alias("text"))).groupBy("conv_id").agg(
        turns_of(F.max_by("formatted", "example")).alias("turns"), F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]).alias("loss"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars")
    )
