"""Chat formatting: event-sourced reconstruction of conversations, then a reversible template with a loss mask.

Main path: DataFrame functions only. A log has rows (conv, seq, kind, msg, role, text). Kinds:
  message     opens message `msg` with a role and a text
  delta       appends streamed text to message `msg`
  edit        replaces the text of message `msg`
  regenerate  replaces the text of message `msg` and discards the later messages that existed by then
Folding is declarative: the last message/edit/regenerate event of a message resets its text, the deltas after it
are appended in order, and a message goes if an earlier message was regenerated after its own opening. A regenerate
event of a message that is gone by then is stale and discards nothing; which ones are follows from the regenerate
events of the conversation alone, in order (their number squared; conversations without one cost nothing).

Template: START role END_ROLE text END per turn. Every '&', '<' and '[' of roles and texts is escaped, so no control
string ('<...', '[...') can stand inside a text, and unescaping gives back the exact text.

Defined cases: a null role or text is the empty string; a null conversation id is a conversation like another; an
empty text is still a turn; rows that are equal, or tie in seq, are all kept, in the order (seq, role, text); an
empty log gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hex_sha256, let

START, END_ROLE, END = "<|turn|>", "<|text|>", "<|end|>"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsb;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("&lsb;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fold(events: DataFrame) -> DataFrame:
    """conv, ord, role, text: the final messages of each conversation, in the order in which they were opened."""
    e = events.select(
        "conv", "seq", F.lower("kind").alias("kind"), F.col("msg").alias("msg"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    event = F.struct("seq", "role", "text", "kind")
    reset = F.col("kind").isin(*RESETS)
    by_message = e.groupBy("conv", "msg").agg(
        F.min(F.when(F.col("kind") == "message", F.struct("seq", "role"))).alias("opened"),
        F.max(F.when(reset, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(event)).alias("log"),
    )
    live = F.filter("log", lambda x: F.when(x["kind"] == "delta", x["seq"] > F.coalesce(F.col("reset"), F.lit(-(2**62)))).otherwise(x["kind"].isin(*RESETS) & (x["seq"] == F.col("reset"))))
    # of several resets at one seq the last in (role, text) order counts
    last_reset = let(F.filter(live, lambda x: x["kind"] != "delta"), lambda r: F.coalesce(F.get(r, F.size(r) - 1)["text"], F.lit("")))
    deltas = F.array_join(F.transform(F.filter(live, lambda x: x["kind"] == "delta"), lambda x: x["text"]), "")
    messages = by_message.select(
        "conv", "msg", F.coalesce(F.col("opened.seq"), F.get("log", F.lit(0))["seq"]).alias("opened_seq"),
        F.coalesce(F.col("opened.role"), F.get("log", F.lit(0))["role"]).alias("role"), "regenerated", F.concat(last_reset, deltas).alias("text"),
    )
    event = F.struct("seq", F.col("opened_seq").alias("of"))
    every = e.where(F.col("kind") == "regenerate").select("conv", "msg", "seq").join(messages.select("conv", "msg", "opened_seq").withColumnsRenamed({"conv": "_c", "msg": "_m"}), F.col("conv").eqNullSafe(F.col("_c")) & F.col("msg").eqNullSafe(F.col("_m")))
    every = every.groupBy("_c").agg(F.array_sort(F.collect_list(event)).alias("log"))
    none = F.array().cast("array<struct<seq:bigint,of:bigint>>")
    gone_by_then = lambda kept, x: F.exists(kept, lambda r: (r["of"] < x["of"]) & (x["of"] < r["seq"]))
    fresh = F.aggregate("log", none, lambda kept, x: F.when(gone_by_then(kept, x), kept).otherwise(F.array_append(kept, F.struct(x["seq"].cast("bigint").alias("seq"), x["of"].cast("bigint").alias("of")))))
    cuts = every.select("_c", fresh.alias("cuts"))
    gone = F.exists(F.coalesce("cuts", none), lambda r: (r["of"] < F.col("opened_seq")) & (F.col("opened_seq") < r["seq"]))
    left = messages.join(cuts, F.col("conv").eqNullSafe(F.col("_c")), "left").where(~gone)
    return left.select("conv", F.struct("opened_seq", "msg").alias("ord"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """conv, formatted, loss_spans: one row per conversation; loss_spans are (start, length) of the assistant texts in
    code points of the formatted string, which are the parts that training is to learn."""
    turn = F.struct("ord", "role", "text")
    grouped = messages.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(END_ROLE))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = grouped.select("conv", pieces.alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["loss"].alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        lengths, zero,
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["b"] + len(END)).alias("at"),
            F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + x["h"]).alias("start"), x["b"].alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.select("conv", body.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv, formatted, turns (role, text, loss), read back from the formatted string and its loss spans alone.

    A turn is under the mask if a span starts where its text starts and is as long.
    """
    segments = F.filter(F.split("formatted", F.lit(END.replace("|", r"\|")), -1), lambda s: s.startswith(START))
    raw = F.transform(segments, lambda s: let(F.split(F.substring(s, F.lit(len(START) + 1), F.char_length(s)), END_ROLE.replace("|", r"\|"), 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("role"), F.get(p, F.lit(1)).alias("body"))))
    d = formatted.select("conv", "formatted", "loss_spans", raw.alias("raw"))
    place = lambda a, x: a["at"] + len(START) + F.char_length(x["role"]) + len(END_ROLE)
    element = "array<struct<role:string,text:string,loss:boolean>>"

    def step(a, x):
        span = F.get(F.col("loss_spans"), a["k"])
        loss = F.coalesce((span["start"] == place(a, x)) & (span["length"] == F.char_length(x["body"])), F.lit(False))
        return F.struct(
            (place(a, x) + F.char_length(x["body"]) + len(END)).alias("at"),
            (a["k"] + loss.cast("int")).alias("k"),
            F.array_append(a["turns"], F.struct(unescape(x["role"]).alias("role"), unescape(x["body"]).alias("text"), loss.alias("loss"))).cast(element).alias("turns"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(element).alias("turns"))
    return d.select("conv", "formatted", F.aggregate("raw", zero, step, lambda a: a["turns"]).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what parse() reads."""
    p = parse(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    p = p.select("conv", F.size("turns").cast("bigint").alias("n_turns"), hex_sha256(said).alias("turns_sha256"), learnt.alias("_learnt"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return p.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", F.char_length("_learnt").cast("bigint").alias("loss_chars"), hex_sha256(F.col("_learnt")).alias("loss_sha256"), "formatted_chars")


def as_events(rows: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as a log: each row opens a message of its own, in the order (seq, role, text)."""
    r = rows.select(F.col(conv).alias("conv"), F.col(seq).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("bigint")
    return r.select("conv", n.alias("seq"), F.lit("message").alias("kind"), n.alias("msg"), "role", "text")
