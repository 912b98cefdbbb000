r"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: conv_id, seq (orders a conversation's events), msg (the message an event is about;
messages of a conversation go by it), role, kind and text. A `delta` adds its text to the message, an `edit` puts its text
in the place of all before it, a `regenerate` empties the message. Events are sorted by seq and folded into final
messages, which are rendered in a template.

Template: each turn is <|im_start|>ROLE, a line feed, TEXT, <|im_end|>, a line feed. A control string starts with <| so
texts get one backslash more between < and | wherever those have none or only backslashes between them; taking one
away restores the text. In roles, % and line feeds are percent-encoded besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text of every message that a log's events make up.

    Events without text add nothing; a message's role is that of its first event that has one (else empty); null ids, kinds and places are keys
    like others; events of equal seq go by kind, then text. Events are grouped by message, so a conversation of any length is spread out."""
    e = events.select("conv_id", "msg", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    m = e.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("es"))
    at = F.transform("es", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(-1)))
    m = m.withColumn("last", F.aggregate(at, F.lit(-1), lambda acc, x: F.greatest(acc, x)))
    final = F.transform(
        F.filter("es", lambda x, i: (i >= F.col("last")) & F.coalesce(x["kind"] != "regenerate", F.lit(True))), lambda x: x["text"]
    )
    role = F.filter("es", lambda x: x["role"].isNotNull())
    return m.select("conv_id", "msg", F.coalesce(F.get(role, F.lit(0))["role"], F.lit("")).alias("role"), F.array_join(final, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (array of begin, end: code points of the assistant's texts in formatted, end exclusive) of every conversation."""
    turn = F.struct(
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LEARNT).alias("learnt")
    )
    c = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", turn.alias("t")))).alias("ts"))
    c = c.select("conv_id", F.transform("ts", lambda x: x["t"]).alias("ts"))
    no_spans = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        spans = F.when(t["learnt"], F.concat(acc["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    walked = F.aggregate("ts", F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("spans")), step, lambda acc: acc["spans"])
    return c.select("conv_id", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), walked.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (array of role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts in the spans, unescaped one by one, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def log_of(conversations: DataFrame) -> DataFrame:
    """A log that plays out conversations (conv_id, turn, role, text; other columns are ignored) as a chat service would record them.

    An assistant's message is streamed in two deltas after a first attempt that is regenerated; other messages are sent and
    then edited into their last form. Turns go by turn, then role, then text; rows that repeat a turn are turns of their own; nulls go first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("msg", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    streamed = F.array(event("delta", F.concat(F.lit("~"), first)), event("regenerate", F.lit("")), event("delta", first), event("delta", rest))
    edited = F.array(event("delta", rest), event("edit", F.col("text")))
    log = c.select("conv_id", "msg", "role", F.posexplode(F.when(F.col("role") == LEARNT, streamed).otherwise(edited)).alias("pos", "event"))
    return log.select("conv_id", (F.col("msg") * 8 + F.col("pos")).alias("seq"), "msg", "role", "event.kind", "event.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations (conv_id, formatted, loss_spans)."""
    f = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", under_mask(F.col("formatted"), F.col("loss_spans")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
