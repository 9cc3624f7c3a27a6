"""Chat formatting of typed content parts. DataFrame functions only.

A turn's content is an array of parts (type, text, ref, tokens); ``flattened`` visits them in order: text
stays, an image, audio or document part becomes a numbered placeholder, and its reference, place and token
count are recorded. ``formatted`` joins the turns of a conversation into one string under a template whose
marks cannot occur inside texts: in texts the three characters that marks need are escaped, reversibly.
``parsed`` reads turns and the loss mask back from the string alone.

Template: <s>[ROLE]text[/ROLE]</s> for each turn; the loss mask covers what assistants say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let, scan

#: Placeholder names by part type.
KINDS = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,tokens:int>"
_OPEN, _MID, _CLOSE = "<s>[", "]", "</s>"


def escaped(text: Column) -> Column:
    """Without '<', '[' and ']' ('~' escapes): no mark of the template can occur."""
    for a, b in (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in (("]", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as the single part of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(f"array<{PART}>")


def flattened(parts: Column) -> Column:
    """struct(body, attachments): escaped text with placeholders <kind:k>, and their (type, ref, tokens, order).

    Unknown types and null parts give nothing; a null text is empty; an attachment without a token count
    has 0. The placeholder's number counts attachments of the turn from 0.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull() & (p["type"].isin("text", *KINDS)))
    attached = F.filter(parts, lambda p: p["type"] != "text")
    named = lambda p, n: F.concat(F.lit("<"), p["type"], F.lit(":"), (n - 1).cast("string"), F.lit(">"))
    shown = lambda ps, so_far: F.transform(ps, lambda p, i: F.when(p["type"] == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(named(p, F.get(so_far, i))))
    count = lambda ps: scan(F.transform(ps, lambda p: (p["type"] != "text").cast("int")), lambda x, y: x + y)
    order = let(parts, lambda ps: let(count(ps), lambda so_far: shown(ps, so_far)))
    records = F.transform(attached, lambda p, i: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"), i.cast("int").alias("order")))
    return F.struct(F.array_join(order, "").alias("body"), records.alias("attachments"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, attachments (with turn), tokens of attachments, from turns(conv_id, turn, role, parts).

    Turns are ordered by number, then role and body, so ties have one order; a null turn number comes first,
    a null role is empty. Rows with a null conv_id make one conversation. Other columns are ignored.
    """
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flattened(F.col("parts")).alias("f"))
    one = one.select("conv_id", F.struct("turn", "role", "f.body", "f.attachments").alias("t"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    line = lambda t: F.concat(F.lit(_OPEN), escaped(t["role"]), F.lit(_MID), t["body"], F.lit("[/"), escaped(t["role"]), F.lit(_MID + _CLOSE))
    notes = F.flatten(F.transform("turns", lambda t, k: F.transform(t["attachments"], lambda a: F.struct(k.cast("int").alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), a["order"].alias("order")))))
    out = whole.select("conv_id", F.array_join(F.transform("turns", line), "").alias("formatted"), notes.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parsed(text: Column) -> Column:
    """Turns of a formatted string: array of (role, text, start, stop); start and stop are the mask's code points.

    The escaped text lies at [start, stop) of the string, counted from 0.
    """
    pieces = F.filter(F.split(text, _CLOSE, -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(_OPEN) + 1)), _MID, 1)
    start = lambda p: F.lit(len(_OPEN) + len(_MID)) + F.length(role(p))
    stop = lambda p: F.length(p) - F.length(role(p)) - 3  # noqa: E731  [/role]
    one = F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substr(p, start(p) + 1, stop(p) - start(p))).alias("text"), start(p).alias("start"), stop(p).alias("stop"), F.length(p).alias("n")))
    return one


def masked(turns: Column, role: str = "assistant") -> Column:
    """The loss mask: code point ranges [start, stop) of the formatted string, of the turns of ``role``."""
    ends = lambda ts: scan(F.transform(ts, lambda t: t["n"] + F.lit(len(_CLOSE))), lambda x, y: x + y)

    def spans(ts, end):
        at = lambda t, i: F.get(end, i) - t["n"] - F.lit(len(_CLOSE))
        one = lambda t, i: F.when(t["role"] == role, F.struct((at(t, i) + t["start"]).alias("start"), (at(t, i) + t["stop"]).alias("stop")))
        return F.filter(F.transform(ts, one), lambda x: x.isNotNull())

    return let(turns, lambda ts: let(ends(ts), lambda end: spans(ts, end)))


def digests(chats: DataFrame) -> DataFrame:
    """What a reader of the formatted strings finds: counts and digests by conversation. Texts under the mask are those of the pieces read."""
    read = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("t"))
    said = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    read = read.select("conv_id", "formatted", F.size("t").alias("n"), F.sha2(F.array_join(F.transform("t", said), ""), 256).alias("turns_sha256"), loss.alias("loss"))
    return read.select("conv_id", F.col("n").cast("long").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
