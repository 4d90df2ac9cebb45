"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts. A visitor flattens them in order: text parts become escaped
text, image, audio and document parts become placeholders that carry the part's place in the turn;
for these the reference and the number of tokens that the placeholder expands to are recorded.

Template of a turn::

    <|turn|>role<|body|>content<|end|>

Escaping is reversible: a backslash is doubled, and one is put after the first character of each
control string that a text holds (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so that no
control string outlives it; a backslash read back stands for the character after it.

The loss mask is a list of spans, first byte and byte after the last, over the UTF-8 of the output:
the content of each assistant turn and nothing else.

Defined results: null text is empty, a null role is an empty role and never the assistant's, rows
with a null conversation form one conversation, a null turn comes first; turns with one number are
ordered by role, then text; an empty table gives an empty table. A conversation is one row of the
output, so it has to fit into one value, however many turns it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm import common

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: Pixels of an image's side to a token, tokens to a second of sound, tokens to a page.
PATCH, PER_SECOND, PER_PAGE = 28, 12.5, 256


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=\||/?s>|/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(part: Column, patch: int = PATCH, per_second: float = PER_SECOND, per_page: int = PER_PAGE) -> Column:
    """Tokens that a part's placeholder expands to; at least one, also where its measures are missing."""
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    made = F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * per_second)).when(part["type"] == "document", part["pages"].cast("long") * per_page)
    return F.greatest(F.coalesce(made.cast("long"), F.lit(1)), F.lit(1).cast("long"))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column, **rates: float) -> Column:
    """content, attachments (part, type, ref, tokens) and expanded_tokens of an array of parts (``PARTS``)."""
    numbered = F.transform(parts, lambda p, i: F.struct((i + 1).alias("part"), p.alias("of")))
    said = F.transform(
        numbered,
        lambda x: F.when(is_text(x["of"]), escape(F.coalesce(x["of"]["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(x["of"]["type"]), F.lit(":"), x["part"].cast("string"), F.lit("|>"))),
    )
    kept = F.filter(numbered, lambda x: ~is_text(x["of"]))
    attached = F.transform(kept, lambda x: F.struct(x["part"], x["of"]["type"].alias("type"), x["of"]["ref"].alias("ref"), tokens_of(x["of"], **rates).alias("tokens")))
    total = F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return F.struct(F.coalesce(F.array_join(said, ""), F.lit("")).alias("content"), F.coalesce(attached, F.array()).alias("attachments"), F.coalesce(total, F.lit(0).cast("long")).alias("expanded_tokens"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_conversations(df: DataFrame, parts: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` names a column of content parts; without one, each turn is a single text part.
    """
    content = df[parts] if parts else text_part(df[text])
    rows = df.select(df[conv_id].alias("conv_id"), df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), visit(content).alias("v"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumns({"piece": F.concat(head, F.col("v.content"), F.lit(END)), "lead": F.octet_length(head)})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    size = F.octet_length("piece").cast("long")
    rows = rows.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    rows = rows.withColumn("begin", F.col("start") + F.col("lead"))
    item = F.struct("start", "turn", "role", "piece", "begin", (F.col("begin") + F.octet_length("v.content")).alias("end"), F.col("v.attachments").alias("attachments"), F.col("v.expanded_tokens").alias("tokens"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["begin"], x["end"]))
    attached = F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["turn"], a["part"], a["type"], a["ref"], a["tokens"]))))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"), attached.alias("attachments"), total.alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of an output as (role, text), unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    parted = F.transform(pieces, lambda p: F.split(p, r"<\|body\|>", -1))
    return F.transform(parted, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(F.left(p[1], F.length(p[1]) - len(END))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")).cast("string"))), "")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = format_conversations(rows)
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "expanded_tokens")
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(t, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS e
  FROM (SELECT *, text AS t FROM rows))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + length('<|body|>') + length(e) + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
