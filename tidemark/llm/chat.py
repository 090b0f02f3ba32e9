"""Conversations as training text, with typed content parts, built-in functions only.

A visitor goes over the parts of each turn: text is escaped, an image, audio clip or document becomes a placeholder;
its reference and the tokens that it will expand to are recorded in order. The mask of a conversation says which
stretches of the text are what the assistant said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BETWEEN, END = "<|start|>", "<|says|>", "<|end|>"
#: Tokens that a part expands to where it doesn't say so itself.
TOKENS = {"image": 576, "audio": 250, "document": 1024}
PART = "struct<type:string,text:string,ref:string,tokens:int>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Control strings begin with "<|"; within a text that becomes "<\\|", and a backslash two."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text again; a backslash before a hyphen stands for nothing, it keeps apart what would become a control string."""
    return F.regexp_replace(text, r"\\(?:(\\)|-|(?=\|))", "$1")


def visit(parts: Column) -> Column:
    """struct(text, attachments) of the parts of a turn: parts of unknown type count as text, null ones as nothing.

    Each text is escaped for itself; one that ends with "<" is marked, so that it can't make a control string with the next.
    """
    kind = lambda p: F.lower(F.coalesce(p["type"], F.lit("text")))
    is_file = lambda p: kind(p).isin(*TOKENS)
    known = F.filter(parts, lambda p: p.isNotNull())
    said = lambda p: F.coalesce(p["text"], F.lit(""))
    mark = lambda p, i: F.when(F.endswith(said(p), F.lit("<")) & (i < F.size(known) - 1), "\\-").otherwise("")
    shown = F.transform(known, lambda p, i: F.when(is_file(p), F.concat(F.lit("<|"), kind(p), F.lit("|>"))).otherwise(F.concat(escape(said(p)), mark(p, i))))
    default = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])
    files = F.transform(F.filter(known, is_file), lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.element_at(default, kind(p))).alias("tokens")))
    return F.struct(F.array_join(shown, "").alias("text"), files.alias("attachments"))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conv_id, formatted, mask, attachments, expanded_tokens), one row for each conversation.

    mask has (start, end) in code points of formatted. Turns are in order of turn; equal ones in order of role and
    text, null turns first. Null roles and texts are empty; null conv_ids make one conversation. Repeated rows are
    turns of their own. If parts names a column of arrays of PART, its parts follow the text.
    """
    own = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    content = F.concat(own, F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))) if parts else own
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    seen = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), visit(content).alias("v"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(BETWEEN))
    made = seen.select("conv_id", F.struct("turn", "role", F.concat(head, F.col("v.text"), F.lit(END)).alias("written"), F.length(head).alias("head"), F.length("v.text").alias("size"), F.col("v.attachments").alias("attachments")).alias("t"))
    by_conv = made.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # places of the turns: a fold over their lengths that hands on where the next one begins
    step = lambda acc, x: F.named_struct(F.lit("at"), acc["at"] + F.length(x["written"]), F.lit("mask"), F.when(x["role"] == LEARNED, F.concat(acc["mask"], F.array(F.named_struct(F.lit("start"), acc["at"] + x["head"], F.lit("end"), acc["at"] + x["head"] + x["size"])))).otherwise(acc["mask"]))
    zero = F.named_struct(F.lit("at"), F.lit(0), F.lit("mask"), F.array().cast("array<struct<start:int,end:int>>"))
    mask = F.aggregate("t", zero, step, lambda acc: acc["mask"])
    files = F.flatten(F.transform("t", lambda x: x["attachments"]))
    return by_conv.select("conv_id", F.array_join(F.transform("t", lambda x: x["written"]), "").alias("formatted"), mask.alias("mask"), files.alias("attachments"), F.aggregate(F.transform(files, lambda f: f["tokens"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    turns = F.filter(F.split(text, F.lit("<\\|end\\|>")), lambda x: x != "")
    sides = F.transform(turns, lambda x: F.split(F.substring(x, len(START) + 1, F.length(x)), F.lit("<\\|says\\|>"), 2))
    return F.transform(sides, lambda s: F.struct(unescape(F.element_at(s, 1)).alias("role"), unescape(F.element_at(s, 2)).alias("text")))


def report(done: DataFrame) -> DataFrame:
    """Figures read back from what formatted() returns."""
    learned = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    read = done.select("conv_id", parsed(F.col("formatted")).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "expanded_tokens")
