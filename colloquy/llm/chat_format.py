"""Conversations with typed content parts to one training text each, with its loss spans and attachments.

All of it is column expressions: a visitor over the parts of a turn, a template over the turns of a conversation
and a reader that takes the output apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type: string, text: string, ref: string, amount: double>>"
# tokens that one unit of an attachment takes once expanded: image tiles, audio seconds, document pages
RATES = {"image": 256.0, "audio": 25.0, "document": 512.0}
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Every backslash doubled and every ``<|`` parted by one, so no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As in texts, and line feeds as ``\\n``, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Marks each pair by what cannot follow a backslash in the escaped form, then resolves it in one pass."""
    return F.array_join(
        F.transform(F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1)),
                    lambda x: F.when(x == "\\n", "\n").when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)), "")


def text_parts(text: Column) -> Column:
    """A plain text as its only part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))).cast(PARTS)


def _is(part: Column, kind: str) -> Column:
    return F.coalesce(F.lower(part["type"]), F.lit("text")) == kind


def flatten_part(part: Column) -> Column:
    """Visitor: escaped text, or a placeholder that names the kind and the ordinal-free reference."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in RATES:
        out = F.when(_is(part, kind), F.lit(f"<|{kind}|>")).otherwise(out)
    return out


def attachment_tokens(part: Column) -> Column:
    """Tokens of the expanded placeholder: the rate times the amount (1 if null), rounded up, at least 1."""
    out = F.lit(0).cast("long")
    for kind, rate in RATES.items():
        out = F.when(_is(part, kind), F.greatest(F.lit(1), F.ceil(F.coalesce(part["amount"], F.lit(1.0)) * rate))).otherwise(out)
    return out.cast("long")


def format_conversations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is of type ``PARTS``; build it with ``text_parts`` for plain texts. Turns go by ``turn`` (null first),
    equal ones by role and content, repeated rows stay. A null role or part text is empty, a part of unknown type
    counts as text, null or empty parts give an empty text. ``loss_spans`` are (turn, start, length, offset) in code points,
    start in ``formatted`` and offset in the turn, both from 0, one for each turn of role ``learn``. ``attachments``
    are (turn, position in ``formatted``, type, ref, tokens) in order; ``expanded_tokens`` is their sum. A null conversation id is a conversation of its own. Other
    columns are left out.

    Each turn is flattened where it is read; the one shuffle sorts the flat turns of a conversation (spilling if
    long), a running sum places them, and they are joined, since a conversation's text is one value.
    """
    seen = F.coalesce(F.filter(F.col(parts), lambda p: p.isNotNull()), F.array().cast(PARTS))
    pieces = F.transform(seen, flatten_part)
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    kept = F.filter(
        F.transform(seen, lambda p, i: F.struct(before(i).alias("position"), F.lower(p["type"]).alias("type"), p["ref"].alias("ref"), attachment_tokens(p).alias("tokens"))),
        lambda a: a["tokens"] > 0,
    )
    body = F.array_join(pieces, "")
    head = F.concat(F.lit(START), escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"))
    flat = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        head.alias("head"), body.alias("body"), kept.alias("attachments"),
    ).withColumn("block", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments")
    placed = flat.select(
        "conv_id", F.struct(
            (F.row_number().over(order) - 1).alias("turn"),
            F.coalesce(F.sum(F.length("block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"),
            "block", (F.col("role") == learn).alias("learn"), F.length("head").alias("head"), F.length("body").alias("body"), "attachments",
        ).alias("t"),
    )
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(
        t["turn"].alias("turn"), (t["at"] + t["head"]).alias("start"), t["body"].alias("length"), t["head"].alias("offset")))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
        t["turn"].alias("turn"), (t["at"] + t["head"] + a["position"]).alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        spans.alias("loss_spans"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_blocks(formatted: Column) -> Column:
    """The turns of a formatted text as they stand in it, without their end marks."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted text, unescaped; placeholders stay."""
    cut = lambda b: F.instr(b, "\n")
    return F.transform(read_blocks(formatted), lambda b: F.struct(
        unescape_role(F.substring(b, F.lit(len(START) + 1), cut(b) - len(START) - 1)).alias("role"),
        unescape(F.substring(b, cut(b) + 1, F.length(b))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order. Each is cut from its own turn, so long conversations take linear time."""
    blocks = read_blocks(formatted)
    return F.transform(spans, lambda s: unescape(F.substring(F.element_at(blocks, s["turn"] + 1), s["offset"] + 1, s["length"])))
