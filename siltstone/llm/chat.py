"""Chat formatting from typed content parts, with built-in functions only.

A conversation becomes one string of turns::

    <turn ROLE>CONTENT</turn>

each followed by a newline.  Inside roles, texts and references the
characters that could build a control string are written as two-character
codes (see :data:`CODES`), so no text can open or close a turn or fake a
placeholder, and the codes are undone exactly.  Media parts become ordered
placeholders ``<KIND n>``, n counting the attachments of the conversation
from 0; what they stand for is listed beside the string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Character and code, in the order of escaping; the backslash is first, and last when undone.
CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))
END = "</turn>\n"
#: Kinds of media part and the tokens of one unit (image tile, audio second, document page) in the expanded count.
MEDIA_UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PART_TYPE = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return reduce(lambda c, code: F.replace(c, F.lit(code[0]), F.lit(code[1])), CODES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, code: F.replace(c, F.lit(code[1]), F.lit(code[0])), reversed(CODES), text)


def text_part(text: Column) -> Column:
    """One text part as an array of parts; a null text is an empty one."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")
        )
    )


class PartVisitor:
    """Flattens the parts of a turn: one method per kind gives a part's rendered form, its reference and its tokens.

    ``number`` is the attachment's number in its conversation.  A part of an
    unknown kind is rendered as its text.
    """

    def __init__(self, unit_tokens: dict[str, int] | None = None):
        self.unit_tokens = MEDIA_UNIT_TOKENS if unit_tokens is None else unit_tokens

    def is_media(self, part: Column) -> Column:
        return F.coalesce(part["kind"].isin(*self.unit_tokens), F.lit(False))

    def visit_text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def visit_media(self, part: Column, number: Column) -> Column:
        return F.concat(F.lit("<"), part["kind"], F.lit(" "), number.cast("string"), F.lit(">"))

    def expanded_tokens(self, part: Column) -> Column:
        """Tokens that the placeholder expands to: units (1 if null) times the tokens of a unit of its kind."""
        each = F.create_map(*[F.lit(x) for pair in self.unit_tokens.items() for x in pair])
        return F.coalesce(part["units"], F.lit(1)) * F.element_at(each, part["kind"]).cast("long")

    def visit(self, parts: Column, before: Column) -> Column:
        """The turn's content; ``before``: attachments of the turns before."""
        media = F.filter(parts, self.is_media)
        plain = F.transform(parts, lambda p: F.when(~self.is_media(p), self.visit_text(p)).otherwise(F.lit("")))
        numbered = F.transform(
            parts,
            lambda p, i: F.when(
                self.is_media(p), self.visit_media(p, before + F.size(F.filter(F.slice(parts, 1, i + 1), self.is_media)) - 1)
            ).otherwise(F.element_at(plain, i + 1)),
        )
        return F.array_join(F.when(F.size(media) == 0, plain).otherwise(numbered), "")


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", train_roles: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None
) -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans, attachments, n_expanded_tokens.

    ``parts_col`` is an array of :data:`PART_TYPE` (see :func:`text_part` for
    plain text).  Rows are ordered by turn, ties by role and content, so
    repeated rows all appear and results are stable.  A null role is the empty
    role, a null array of parts no parts, a null conversation id a
    conversation of its own.  An empty table gives no rows; other columns are
    not read.

    ``loss_spans``: array of (turn_index, start, start_in_turn, length), in
    code points: ``start`` within ``formatted``, ``start_in_turn`` within the
    turn.  They cover exactly the content of the turns of ``train_roles``.
    ``attachments``: array of (number, turn_index, kind, ref, expanded_tokens)
    in order.  ``n_expanded_tokens``: their sum, 0 without any.

    One shuffle by conversation; the window and the aggregation share it.  A
    conversation is one string, so its rows meet in one task by definition.
    """
    visitor = visitor or PartVisitor()
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("role"), F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>")).alias("parts")
    )
    rows = rows.withColumn("media", F.filter("parts", visitor.is_media)).withColumn("tie", F.to_json("parts"))
    order = Window.partitionBy("c").orderBy("t", "role", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("index", F.row_number().over(order) - 1).withColumn("n_before", F.coalesce(F.sum(F.size("media")).over(before), F.lit(0)))
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    rows = rows.withColumn("head", head).withColumn("content", visitor.visit(F.col("parts"), F.col("n_before")))
    length = (F.length("head") + F.length("content") + len(END)).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)))
    span = F.struct(
        F.col("index").alias("turn_index"), (F.col("at") + F.length("head")).alias("start"), F.length("head").alias("start_in_turn"), F.length("content").alias("length")
    )
    attached = F.transform(
        "media",
        lambda p, i: F.struct(
            (F.col("n_before") + i).cast("long").alias("number"), F.col("index").alias("turn_index"), p["kind"].alias("kind"), p["ref"].alias("ref"), visitor.expanded_tokens(p).alias("expanded_tokens")
        ),
    )
    one = F.struct("index", F.concat("head", "content", F.lit(END)).alias("turn"), F.when(F.col("role").isin(*train_roles), span).alias("span"), attached.alias("attached"))
    whole = rows.groupBy("c").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return whole.select(
        F.col("c").alias(conv_col),
        F.array_join(F.col("all.turn"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("all.attached")).alias("attachments"),
    ).withColumn("n_expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["expanded_tokens"]))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations what can be read back: ``turns`` (array of role, text) and ``loss_texts``.

    Turns are split at their end marks and unescaped; a placeholder stays as
    it stands.  ``loss_texts`` are cut out of the string at the loss spans.
    """
    ends = F.split("formatted", END)
    parts = F.slice(ends, 1, F.size(ends) - 1)
    df = formatted.withColumn("_pieces", parts)
    turns = F.transform(
        "_pieces",
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len("<turn ") + 1, 1 << 30), ">", 1)).alias("role"),
            unescape(p.substr(F.locate(">", p) + 1, F.length(p))).alias("text"),
        ),
    )
    cut = F.transform("loss_spans", lambda s: unescape(F.element_at("_pieces", s["turn_index"] + 1).substr(s["start_in_turn"] + 1, s["length"])))
    return df.withColumn("turns", turns).withColumn("loss_texts", cut).drop("_pieces")
