"""Chat formatting with typed content parts, control strings and a loss mask.

A turn's content is a list of typed parts. A visitor flattens them in order:
text parts are escaped, every other part becomes one placeholder and an
attachment record with its reference and the number of tokens it expands to.
All of it is column expressions; one shuffle brings the turns of a
conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens an attachment expands to: image patches of 28 pixels, audio frames, page tokens.
PATCH, AUDIO_PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    """No ``<|`` remains: one backslash more between ``<`` and ``|``, whatever stood there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: backslashes doubled, line breaks written out, control strings escaped."""
    doubled = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p|"))


def unescape_role(role: Column) -> Column:
    # Doubled backslashes are set aside under a character that escaped roles hold only in pairs of marks.
    parts = F.split(role, r"\\\\")
    plain = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit("<\\p|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    )
    return F.array_join(plain, "\\")


def text_parts(text: Column) -> Column:
    """Plain text as a list with one text part (null: an empty text)."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for; unknown sizes count one token."""
    sides = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.greatest(
        F.lit(1).cast("bigint"),
        F.coalesce(
            F.when(part["type"] == "image", sides)
            .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_PER_SECOND))
            .when(part["type"] == "document", part["pages"].cast("bigint") * PER_PAGE),
            F.lit(1),
        ).cast("bigint"),
    )


def shown_type(kind: Column) -> Column:
    """A part's type as it may stand in a placeholder: it can neither end one nor be a mark of turns."""
    plain = F.regexp_replace(F.coalesce(kind, F.lit("unknown")), r"[^\p{L}\p{N}_]", "_")
    return F.when(plain.rlike("^im_"), F.concat(F.lit("part_"), plain)).otherwise(plain)


def flatten_parts(parts: Column) -> Column:
    """The visitor: text escaped, other parts as ``<|type|>`` placeholders, in order, as one string.

    A type shows letters, digits and ``_`` of its name only, and stands after ``part_`` if it then reads as a control word.
    """
    return F.array_join(
        F.transform(
            F.coalesce(parts, F.array().cast(f"array<{PART}>")),
            lambda p: F.when(p["type"] == "text", F.coalesce(escape(p["text"]), F.lit("")))
            .otherwise(F.concat(F.lit("<|"), shown_type(p["type"]), F.lit("|>"))),
        ),
        "",
    )


def attachments(parts: Column) -> Column:
    """Attachment records of a list of parts, in the order of their placeholders."""
    return F.transform(
        F.filter(parts, lambda p: ~F.coalesce(p["type"] == "text", F.lit(False))),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    ``formatted`` has the marked turns in the order of (turn, role, content),
    nulls first; ``attachments`` lists what the placeholders stand for and
    ``expanded_tokens`` sums their tokens. A null role is empty, null parts are
    none, rows that are equal stay as often as they come, and turns whose
    conversation id is null form one conversation. No rows in, no rows out.
    Other columns are ignored. A conversation becomes one record by definition
    and so has to fit into a task.
    """
    flat = turns.select(
        "conv_id", "turn", escape_role(F.col("role")).alias("role"),
        flatten_parts(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("files"),
    )
    grouped = flat.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content", "files"))).alias("turns")
    )
    marked = F.transform(
        F.col("turns"),
        lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["content"], F.lit(CLOSE)),
    )
    files = F.flatten(F.transform(F.col("turns"), lambda t: t["files"]))
    return grouped.select(
        "conv_id",
        F.array_join(marked, "").alias("formatted"),
        files.alias("attachments"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate(F.col("attachments"), F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) read from ``formatted``: split at the marks, escapes undone.

    Placeholders of attachments stay in the text as they are.
    """
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_start\|>"), lambda _, i: i > 0)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(
                    p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - F.lit(len(CLOSE))
                )
            ).alias("text"),
        ),
    )
    return formatted.withColumn("turns", turns)


def loss_texts(turns: Column, role: str = "assistant") -> Column:
    """Texts under the loss mask: those of the turns that the model is to write."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])
