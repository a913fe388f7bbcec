"""Chat formatting by a grammar that is parsed back.

A turn is written with the markers of its role:

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    any other  [ROLE]role[/ROLE][TEXT]text[/TEXT]

Wherever a text or a role holds a control string it is escaped: a tilde is put behind the first
character of the control string (or of one that already has tildes there), which the parser takes
out again. This maps texts one to one onto texts without control strings, so no control string in
the output comes from a text. What holds none is written as it is. The written form is parsed back
and compared to the source in every role and text; the result is what the parser found, and a
conversation that differed would stop the job rather than pass: the round trip is checked, not assumed.

Everything is a DataFrame function; a conversation's turns meet in one row, which its single
formatted string needs in any case.

Defined cases: null text is empty; a null role is the empty role; turns of one conversation
are ordered by turn (null first), then role, then text, so ties and repeated rows have one
order; a row with a null conversation id is a conversation of its own. An empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings behind their first character.
CONTROLS = r"/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/?TEXT\]"
_PLAIN = rf"([<\[])(~*)({CONTROLS})"
_ESCAPED = rf"([<\[])~(~*)({CONTROLS})"
_TURN = (
    r"(?s)(?:\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|<<SYS>>(.*?)<</SYS>>|\[ROLE\](.*?)\[/ROLE\]\[TEXT\](.*?)\[/TEXT\])"
)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def rendered(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[/ROLE][TEXT]"), text, F.lit("[/TEXT]")))
    )


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(escaped(t["role"]), escaped(t["text"]))), "")


def _raw_turn(turn: Column) -> Column:
    """Role and text, still escaped, of one turn's written form."""
    inner = lambda head, tail: F.substr(turn, F.lit(head + 1), F.length(turn) - head - tail)
    role = F.regexp_extract(turn, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
    return (
        F.when(turn.startswith("[INST] "), F.struct(F.lit("user").alias("role"), inner(7, 8).alias("text"), F.lit(7).alias("head")))
        .when(turn.startswith("<s>"), F.struct(F.lit("assistant").alias("role"), inner(3, 4).alias("text"), F.lit(3).alias("head")))
        .when(turn.startswith("<<SYS>>"), F.struct(F.lit("system").alias("role"), inner(7, 8).alias("text"), F.lit(7).alias("head")))
        .otherwise(
            F.struct(
                unescaped(role).alias("role"),
                F.regexp_extract(turn, r"(?s)^\[ROLE\].*?\[/ROLE\]\[TEXT\](.*)\[/TEXT\]$", 1).alias("text"),
                (F.length(role) + 19).alias("head"),
            )
        )
    )


def _cut(formatted: Column) -> Column:
    """The written turns of a formatted conversation, in order; null where anything is left between."""
    turns = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    return F.when(F.array_join(turns, "") == formatted, turns)


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null if it isn't one."""
    return F.transform(_cut(formatted), lambda t: F.struct(_raw_turn(t)["role"].alias("role"), unescaped(_raw_turn(t)["text"]).alias("text")))


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, escaped (whether a text or role was), turns as parsed back, and loss_spans.

    loss_spans: start (0-based, in characters of ``formatted``) and length of each assistant text.
    """
    source = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    met = source.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    alone = source.where("conv_id IS NULL").select("conv_id", F.array("t").alias("t"))
    ordered = met.unionByName(alone).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    risky = F.exists("source", lambda t: t["role"].rlike(_PLAIN) | t["text"].rlike(_PLAIN))
    written = ordered.withColumn("formatted", _written(F.col("source"))).withColumn("escaped", risky)
    back = written.withColumn("cut", _cut(F.col("formatted"))).withColumn("raw", F.transform("cut", _raw_turn))
    at = F.aggregate(
        F.col("raw"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + F.length(t["text"]) + F.when(t["role"] == "assistant", 4).when(t["role"].isin("user", "system"), 8).otherwise(7)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), F.length(t["text"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    result = back.select(
        "conv_id",
        "formatted",
        "escaped",
        F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescaped(t["text"]).alias("text"))).alias("turns"),
        at.alias("loss_spans"),
        "source",
    )
    wrong = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return result.withColumn("turns", F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(wrong)).drop("source")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read from the formatted strings, their parsed turns and the loss mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.encode("masked", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
