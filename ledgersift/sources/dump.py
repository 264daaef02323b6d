"""Reading and writing the ledger table as a MySQL dump of INSERT statements.

A dump can be cut at any line: whether a line begins inside a quoted string
depends on all lines before it. Every block of a file therefore reports, for each state
it may begin in, the state it ends in and the statements it closes; composed in
the order of the blocks, this fixes the true states. The blocks then cut their
statements, and only statements that cross blocks are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.config import LEDGER_COLUMNS, TIMESTAMP_COLUMNS
from ledgersift.session import materialize

OUT, SINGLE, DOUBLE = 0, 1, 2  # outside strings, inside '...', inside "..."
# From a state on: all that neither ends a statement nor leaves the line inside a string.
_SKIP = (
    re.compile(r"""(?:[^'";]++|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")*+""", re.S),
    re.compile(r"(?:[^'\\]++|\\.)*+", re.S),
    re.compile(r'(?:[^"\\]++|\\.)*+', re.S),
)
_COMMENT = re.compile(r"\s*(?:--(?:\s|$)|#)")
_STRING = r"""'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+\""""
# A cell without brackets of its own.
_CELL = re.compile(rf"""(?:[^'"(){{}}\[\],]++|{_STRING})*+""", re.S)
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+"|[(){}\[\],;]|[^'"(){}\[\],;]++|['"]""", re.S)


def scan_line(line: str, state: int) -> tuple[int, list[int]]:
    """(state after the line, places of the semicolons that end statements) of a line that begins in ``state``.

    A backslash at the end of a line escapes the line break. Comment lines count only outside strings.
    """
    if state == OUT and _COMMENT.match(line):
        return OUT, []
    at, ends = 0, []
    while (at := _SKIP[state].match(line, at).end()) < len(line):
        mark = line[at]
        at += 1
        if mark == ";":
            ends.append(at - 1)
        elif state != OUT and mark != "\\":
            state = OUT
        elif state == OUT:
            # The string does not end in this line.
            return (SINGLE if mark == "'" else DOUBLE), ends
        else:
            break
    return state, ends


def split_rows(body: str) -> tuple[list[list[str]], list[str]]:
    """(tuples as lists of cells, stretches that are no tuple) of a VALUES list.

    Cells are trimmed and keep their quotes. Brackets and braces nest to any depth; strings
    may hold anything. What is left open at the end is a stretch of its own.
    """
    rows, strays, at = [], [], 0
    while at < len(body):
        if body[at] == "(":
            cells, end = _tuple(body, at)
            if end < 0:
                strays.append(body[at:].strip())
                break
            rows.append(cells)
            at = end
        else:
            token = _TOKEN.match(body, at)
            if token.group().strip(" \t\r\n,;"):
                strays.append(token.group().strip())
            at = token.end()
    return rows, strays


def _tuple(body: str, start: int) -> tuple[list[str], int]:
    """(cells, end) of the tuple that opens at ``start``; the end is -1 if it is left open."""
    cells, at = [], start + 1
    last = at
    while (end := _CELL.match(body, at).end()) < len(body):
        mark, at = body[end], end + 1
        if mark in "({[":
            depth = 1
            while depth:
                token = _TOKEN.match(body, at)
                if token is None:
                    return [], -1
                depth += (token.group() in ("(", "{", "[")) - (token.group() in (")", "}", "]"))
                at = token.end()
        elif mark not in "'\"":
            cells.append(body[last:end].strip())
            last = at
            if mark != ",":
                return cells, at
    return [], -1


def cell_value(raw: Column) -> Column:
    """A dump cell as text: NULL becomes null, quotes go, escaped quotes and backslashes are undone."""
    text = F.trim(raw)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    # Doubled backslashes are parted off first; what is left of an escape is its own pair.
    pieces = F.transform(F.split(inner, r"\\\\"), _undone)
    plain = F.array_join(pieces, "\\")
    return (
        F.when(F.upper(text) == "NULL", F.lit(None).cast("string"))
        .when(text.startswith("'") & text.endswith("'"), plain)
        .otherwise(text)
    )


def _undone(piece: Column) -> Column:
    # A doubled quote stands for one, unless its first half belongs to an escape.
    piece = F.regexp_replace(piece, r"(?<!\\)''", "'")
    for written, meant in (("\\'", "'"), ("\\n", "\n"), ("\\r", "\r")):
        piece = F.replace(piece, F.lit(written), F.lit(meant))
    return piece


def typed_column(name: str, text: Column) -> Column:
    """The load-time cast of a ledger column; what does not parse becomes null."""
    if name in TIMESTAMP_COLUMNS:
        return text.try_cast("timestamp_ntz").alias(name)
    if name == "amount":
        return text.try_cast("double").alias(name)
    if name == "state":
        return text.try_cast("bigint").alias(name)
    return text.alias(name)


_BLOCK = "path string, block long"
PIECE_BYTES = 4 << 20  # text a task turns into Python objects at a time


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose last column, a text, holds about ``PIECE_BYTES`` at most (one row at least)."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + PIECE_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """The lines of a task's blocks: ((path, block, other columns), list of lines) in pieces."""
    for batch in _bounded(batches):
        columns = [c.to_pylist() for c in batch.columns]
        heads = list(zip(*columns[:-1], strict=True))
        at = 0
        while at < len(heads):
            end = at + 1
            while end < len(heads) and heads[end] == heads[at]:
                end += 1
            yield heads[at], columns[-1][at:end]
            at = end


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and possible first state the last state and the number of statements that end."""
    held: dict[tuple, tuple[list[int], list[int]]] = {}
    for key, lines in _blocks(batches):
        states, ends = held.setdefault(key, ([OUT, SINGLE, DOUBLE], [0, 0, 0]))
        for line in lines:
            for first in (OUT, SINGLE, DOUBLE):
                states[first], found = scan_line(line, states[first])
                ends[first] += len(found)
    rows = [{"path": p, "block": b, "states": states, "ends": ends} for (p, b), (states, ends) in held.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("states", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64()))]))


def _starts(frame: pd.DataFrame) -> pd.DataFrame:
    """The true first state of every block of one file, and the statements closed before it."""
    frame = frame.sort_values("block")
    state, before, rows = OUT, 0, []
    for block, states, ends in zip(frame["block"], frame["states"], frame["ends"], strict=True):
        rows.append((frame["path"].iloc[0], block, state, before))
        before += ends[state]
        state = states[state]
    return pd.DataFrame(rows, columns=["path", "block", "state", "before"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of lines with their block's first state; ``whole`` tells those that begin and end in the block."""
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
    now, state, number, inner, text = None, OUT, 0, False, []

    def made(whole: bool) -> dict:
        return {"path": now[0], "number": number, "block": now[1], "whole": whole, "text": "".join(text)}

    for key, lines in _blocks(batches):
        rows = []
        if key[:2] != now:
            if now is not None and text:
                rows.append(made(False))
            now, state, number, inner, text = key[:2], key[2], key[3], False, []
        for line in lines:
            comment = state == OUT and _COMMENT.match(line)
            state, ends = scan_line(line, state)
            at = 0
            for end in ends:
                text.append(line[at:end])
                rows.append(made(inner))
                number, inner, text, at = number + 1, True, [], end + 1
            if not comment:
                text.append(line[at:] + "\n")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if now is not None and text:
        yield pa.RecordBatch.from_pylist([made(False)], schema=schema)


def read_statements(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(text): the statements of dump files, without their semicolons; comment lines are left out.

    Files are read in parallel blocks that may begin anywhere; a statement must fit into a task.
    """
    value = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        # The text source hands the bytes through as they are.
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), value.alias("value")
    )
    known = lines.mapInArrow(_summaries, f"{_BLOCK}, states array<int>, ends array<long>")
    # Written once: else every reading of the statements would first scan the whole dump again.
    starts = materialize(known.groupBy("path").applyInPandas(_starts, f"{_BLOCK}, state int, before long"))
    # One row per block of a file: some 100 bytes for each 128 MB read.
    placed = lines.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "state", "before", "value")
    pieces = placed.mapInArrow(_pieces, "path string, number long, block long, whole boolean, text string")
    crossing = pieces.where(~F.col("whole")).groupBy("path", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text")
    )
    return pieces.where("whole").select("text").unionByName(crossing.select("text"))


def read_dump(
    spark: SparkSession, path: str, table: str = "expenses", encoding: str = "UTF-8"
) -> tuple[DataFrame, DataFrame]:
    """Load a dump: (typed ledger rows, rejected stretches).

    Column names come from the first statement on ``table``. Tuples with another number of cells are rejected, and
    so is what stands in a VALUES list and is no tuple. Strings may hold
    semicolons, line breaks and whole statements; braces and parentheses may nest.
    """
    head = rf"(?is)^\s*INSERT\s+INTO\s+`?{table}`?\s*\(([^)]+)\)\s*VALUES\s*(.*)"
    statements = read_statements(spark, path, encoding).select(
        F.regexp_extract("text", head, 1).alias("names"), F.regexp_extract("text", head, 2).alias("body"),
    ).where(F.col("names") != "")
    first = statements.select("names").first()
    if first is None:
        raise ValueError(f"no INSERT INTO {table} (...) statement in {path}")
    columns = [c.strip().strip("`") for c in first["names"].split(",") if c.strip()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            for body in batch.column(0).to_pylist():
                rows, strays = split_rows(body)
                cells = rows + [None] * len(strays)
                shown = [None if len(r) == len(columns) else "(" + ", ".join(r) + ")" for r in rows] + strays
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.list_(pa.string())), pa.array(shown, pa.string())], ["cells", "row"]
                )

    cells = statements.select("body").mapInArrow(split, "cells array<string>, row string")
    rows = cells.where(F.col("row").isNull()).select(
        *[typed_column(c, cell_value(F.col("cells")[i])) for i, c in enumerate(columns)]
    )
    rejected = cells.where(F.col("row").isNotNull()).select(
        "row", F.coalesce(F.size("cells"), F.lit(0)).alias("found"), F.lit(len(columns)).alias("expected")
    )
    return rows, rejected


def literal(name: str, kind: str) -> Column:
    """A column as a dump literal."""
    value = F.col(name)
    if name in TIMESTAMP_COLUMNS or kind.startswith("timestamp"):
        shown = F.concat(F.lit("'"), F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    elif kind in ("double", "float") or kind.startswith("decimal"):
        shown = F.format_string("%.2f", value.cast("double"))
        shown = F.when(F.isnan(value.cast("double")), F.lit(None)).otherwise(shown)
    elif kind in ("int", "bigint", "smallint", "tinyint"):
        shown = value.cast("string")
    else:
        safe = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
        safe = F.replace(F.replace(safe, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        shown = F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(F.coalesce(shown, F.lit("NULL")))


def write_dump(
    df: DataFrame, path: str, table: str = "expenses", batch: int = 100, encoding: str = "UTF-8"
) -> None:
    """Write INSERT statements of up to ``batch`` rows, one text file per partition.

    ``encoding`` may be UTF-8 or one of a byte per character that holds every character
    of the rows; any other character is an error.

    Literals are formatted by column expressions; only the joining of finished
    row texts into statements is done in Python, within a partition.
    """
    columns = [c for c in LEDGER_COLUMNS if c in df.columns]
    kinds = dict(df.dtypes)
    parts = F.concat_ws(", ", *[literal(c, kinds[c]) for c in columns])
    rows = df.select(F.concat(F.lit("  ("), parts, F.lit(")")).alias("row"))
    names = ", ".join(f"`{c}`" for c in columns)
    prefix = f"INSERT INTO `{table}` ({names}) VALUES\n"

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for piece in _bounded(batches):
            held += piece.column(0).to_pylist()
            full = len(held) - len(held) % batch
            made = [prefix + ",\n".join(held[i : i + batch]) + ";" for i in range(0, full, batch)]
            held = held[full:]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([prefix + ",\n".join(held) + ";"], pa.string())], ["value"])

    made = rows.mapInArrow(statements, "value string")
    if encoding != "UTF-8":
        # The text sink writes the bytes it is given.
        made = made.select(F.encode("value", encoding).cast("string").alias("value"))
    made.write.text(path)
