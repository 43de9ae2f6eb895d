"""Chat formatting with a grammar round trip.

The template marks every turn by its role:
    user       <s>[INST] text [/INST]
    assistant  (a space) text </s>
    system     <<SYS>> line break text line break <</SYS>> two line breaks
    others     <<ROLE>> role <</ROLE>> line break text line break <</TURN>>
written without further spaces. The parser reads this grammar turn by turn: turns
must follow one another without a gap, and no control string may stand inside a
text or role. Each text is unescaped as it is read.

Method: texts are rendered as they are, parsed again and compared with the source
turns. Where anything differs, the texts with conflicting content are escaped and
the round trip is made again, until it is identical; a second difference would be
an error. Escaping puts one more backslash after the first character of a
control string, or of what escaping makes of one; unescaping takes one away, so
it is reversible and leaves other texts as they are.

The loss mask is a list of runs over the formatted text: a number of characters
and whether they count, which the texts of assistants do.

DataFrame functions only. A conversation is one row of the result by its nature.
Turns come by number, a missing one first, then by role and text; null texts and
roles are empty; turns without a conversation are one of their own. Repeated rows
are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows the first character of a control string.
REST = r"(/?s>|/?INST\]|</?SYS>>|</?ROLE>>|</TURN>>)"
CONTROL = rf"[<\[]{REST}"
#: (before, after) the text of a turn.
USER, ASSISTANT, SYSTEM = ("<s>[INST] ", " [/INST]"), (" ", "</s>"), ("<<SYS>>\n", "\n<</SYS>>\n\n")
OTHER = ("<<ROLE>>", "<</ROLE>>\n", "\n<</TURN>>")
TURN = r"<s>\[INST\] [\s\S]*? \[/INST\]| [\s\S]*?</s>|<<SYS>>\n[\s\S]*?\n<</SYS>>\n\n|<<ROLE>>[\s\S]*?<</ROLE>>\n[\s\S]*?\n<</TURN>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){REST}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){REST}", r"$1$2$3")


def around(role: Column, raw_role: Column) -> tuple[Column, Column]:
    """What stands before and after the text of a turn; role as it is to be written, raw_role as it is."""
    before = F.when(raw_role == "user", USER[0]).when(raw_role == "assistant", ASSISTANT[0]).when(raw_role == "system", SYSTEM[0]).otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1])))
    after = F.when(raw_role == "user", USER[1]).when(raw_role == "assistant", ASSISTANT[1]).when(raw_role == "system", SYSTEM[1]).otherwise(F.lit(OTHER[2]))
    return before, after


def written(turns: Column, write) -> Column:
    """Per turn (before, text, after, loss), texts and roles put down by write."""

    def one(t: Column) -> Column:
        before, after = around(write(t["role"]), t["role"])
        return F.struct(before.alias("before"), write(t["text"]).alias("text"), after.alias("after"), (t["role"] == "assistant").alias("loss"))

    return F.transform(turns, one)


def rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], p["text"], p["after"])), "")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text as they were before; null where it is not of the grammar."""
    parts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def inner(p: Column, marks: tuple[str, str]) -> Column:
        return F.substring(p, F.lit(len(marks[0]) + 1), F.length(p) - len(marks[0]) - len(marks[1]))

    def of_other(p: Column) -> Column:
        role = F.regexp_extract(p, r"^<<ROLE>>([\s\S]*?)<</ROLE>>\n", 1)
        skip = F.length(role) + len(OTHER[0]) + len(OTHER[1])
        return F.struct(role.alias("role"), F.substring(p, skip + 1, F.length(p) - skip - len(OTHER[2])).alias("text"))

    def one(p: Column) -> Column:
        named = lambda role, marks: F.struct(F.lit(role).alias("role"), inner(p, marks).alias("text"))
        return F.when(p.startswith(USER[0]), named("user", USER)).when(p.startswith(ASSISTANT[0]), named("assistant", ASSISTANT)).when(p.startswith(SYSTEM[0]), named("system", SYSTEM)).otherwise(of_other(p))

    turns = F.transform(parts, one)
    whole = F.length(F.array_join(parts, "")) == F.length(formatted)
    strict = F.forall(turns, lambda t: ~t["role"].rlike(CONTROL) & ~t["text"].rlike(CONTROL))
    return F.when(whole & strict, F.transform(turns, lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text"))))


def identical(formatted: Column, turns: Column) -> Column:
    """Whether the formatted text is read back as the turns it was made of."""
    return F.coalesce(parsed(formatted) == turns, F.lit(False))


def format_chats(conversations: DataFrame, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Per conversation: the columns named in by, formatted, mask (chars, loss), n_escaped; of conversations(by, turn, role, text)."""
    own = conversations.select(*by, F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("own_turn"))
    told = own.groupBy(*by).agg(F.array_sort(F.collect_list("own_turn")).alias("told"))
    told = told.withColumn("told", F.transform("told", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = told.withColumn("pieces", written(F.col("told"), lambda x: x)).withColumn("formatted", rendered(F.col("pieces")))
    plain = plain.withColumn("same", identical(F.col("formatted"), F.col("told")))
    # The texts without conflicting content are their own escapes, so only the others change.
    again = plain.withColumn("pieces", F.when(F.col("same"), F.col("pieces")).otherwise(written(F.col("told"), escaped)))
    again = again.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(F.col("pieces"))))
    checked = F.when(F.col("same") | identical(F.col("formatted"), F.col("told")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was")).cast("string"))
    run = lambda chars, loss: F.struct(F.length(chars).alias("chars"), loss.alias("loss"))
    mask = F.flatten(F.transform("pieces", lambda p: F.array(run(p["before"], F.lit(False)), run(p["text"], p["loss"]), run(p["after"], F.lit(False)))))
    n_escaped = F.size(F.filter("told", lambda t: (escaped(t["text"]) != t["text"]) | (escaped(t["role"]) != t["role"])))
    return again.select(*by, checked.alias("formatted"), mask.alias("mask"), F.when(F.col("same"), 0).otherwise(n_escaped).alias("n_escaped"))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted chats: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars beside their own columns."""
    chats = chats.withColumn("told", parsed(F.col("formatted")))
    turns = F.array_join(F.transform("told", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss_text", F.array_join(F.transform(F.filter("told", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""))
    return chats.withColumns(
        {
            "n_turns": F.size("told").cast("long"),
            "turns_sha256": F.sha2(turns.cast("binary"), 256),
            "loss_chars": F.length("loss_text").cast("long"),
            "loss_sha256": F.sha2(F.col("loss_text").cast("binary"), 256),
            "formatted_chars": F.length("formatted").cast("long"),
        }
    ).drop("told", "loss_text")
