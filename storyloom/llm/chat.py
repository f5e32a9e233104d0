"""Chat formatting: typed content parts become one training text with a loss mask. DataFrame functions only.

A turn is written ``<|turn|>ROLE<|body|>BODY<|end|>``. A visitor, one method for each part type, flattens a message's
parts into its body: text is escaped and kept, other parts become numbered placeholders such as ``<|image:1|>``, and
an attachment record keeps their reference and the number of tokens into which a model expands them. Texts of parts
that follow each other are read back as one.

Escaping is reversible: a backslash is doubled, and one backslash goes into every control string of this and of other
common templates (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) after its first
character. No text can then hold a control string, so that the output alone can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
CONTROL = r"([<\[])(?=\||s>|/s>|/?INST\]|</?SYS>>|/?SYS>>)"
#: The first character and the rest of what may begin a control string, at a text's end.
OPEN = r"([<\[])((?:/?s?|/?I?N?S?T?|<?/?S?Y?S?>?)\z)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def escape_open(text: Column) -> Column:
    """Like ``escape``; also what at the text's end could begin a control string that other parts go on with."""
    return F.regexp_replace(escape(text), OPEN, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class PartVisitor:
    """One method for each part type: how it is written, and into how many tokens a model expands it.

    Text counts a token for every four characters, rounded up; other parts so many tokens a unit (image tile, audio
    second, page; none given or under one: one) and a frame around them. Unknown types are written as files of one token.
    A subclass may override a method or, in ``visits``, add a type.
    """

    tile: int = 256
    second: int = 25
    page: int = 600
    frame: int = 2

    def placeholder(self, kind: str, number: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))

    def expanded(self, part: Column, unit: int) -> Column:
        return F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * unit + self.frame

    def visit_text(self, part: Column, number: Column) -> tuple[Column, Column]:
        return escape_open(part_text(part)), F.ceil(F.length(part_text(part)) / 4).cast("long")

    def visit_image(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("image", number), self.expanded(part, self.tile)

    def visit_audio(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("audio", number), self.expanded(part, self.second)

    def visit_document(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("document", number), self.expanded(part, self.page)

    def visit_file(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("file", number), self.expanded(part, 1)

    def visits(self) -> dict:
        return {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def visit(self, part: Column, number: Column, what: int) -> Column:
        """What (0: the text, 1: the tokens) the method of the part's type gives."""
        out = F.when(is_text(part), self.visit_text(part, number)[what])
        for kind, method in self.visits().items():
            out = out.when(part["type"] == kind, method(part, number)[what])
        return out.otherwise(self.visit_file(part, number)[what])

    def tokens(self, part: Column) -> Column:
        return self.visit(part, F.lit(0), 1)


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def part_text(part: Column) -> Column:
    return F.coalesce(part["text"], F.lit(""))


def format_conversations(messages: DataFrame, visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conv_id of messages(conv_id, turn, role, parts).

    Returns conv_id, formatted, n_turns, loss_spans (turn, start, end: code points of ``formatted``, end exclusive),
    attachments (number, turn, type, ref, tokens) and expanded_tokens.

    Null role: the empty one. Null or empty parts, null text: an empty body. Turns come in ascending order, null turns
    first; equal turns by role, then content; repeated rows stay repeated. Null conv_id: one conversation of its own.
    An empty table gives an empty table, and columns besides these four are ignored.
    """
    visitor = visitor or PartVisitor()
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("others", F.filter("parts", lambda p: ~is_text(p)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("base", F.coalesce(F.sum(F.size("others")).over(before), F.lit(0)).cast("long"))

    def written(part: Column, at: Column) -> Column:
        earlier = F.size(F.filter(F.slice("parts", 1, at), lambda p: ~is_text(p)))
        return visitor.visit(part, F.col("base") + earlier + 1, 0)

    # Nearly every message is text alone; it takes the short way without a lambda.
    plain = (F.size("parts") == 1) & (F.size("others") == 0)
    body = F.when(plain, escape(part_text(F.get("parts", F.lit(0))))).otherwise(F.array_join(F.transform("parts", written), ""))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("body", body)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", start.cast("long"))
    attachments = F.transform("others", lambda p, i: F.struct((F.col("base") + i + 1).cast("long").alias("number"), F.col("seq").cast("long").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), visitor.tokens(p).alias("tokens")))
    span = F.struct(F.col("seq").cast("long").alias("turn"), F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    rows = rows.select("conv_id", "seq", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role").isin(*loss_roles), span).alias("span"), attachments.alias("attachments"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + visitor.tokens(p)).alias("tokens"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece", "span", "attachments"))).alias("turns"), F.sum("tokens").alias("expanded_tokens"))
    return gathered.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("turns.attachments").alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text: unescaped) and loss (the unescaped texts under the mask), from the output alone.

    The mask is read by code points of ``formatted``.
    """
    pieces = F.split("formatted", r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    halves = F.transform(pieces, lambda p: F.split(p, r"<\|body\|>", 2))
    turns = F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(h[1]).alias("text")))
    cut = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), cut.alias("loss"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is full of control strings, as digests of what is read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    back = read_back(format_conversations(messages))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
