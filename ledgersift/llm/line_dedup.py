"""Removal of lines that many documents hold, by sharded minimal perfect hashes.

The distinct hashes of lines that at least two documents hold are dealt into shards. A
shard is a minimal perfect hash (levels of bits; a key stands at the first
level where no other key falls on its bit, and its slot is the number of bits
before) over three arrays: fingerprints, document counts and last holders.
Documents send their line hashes to the shards, packed, and get back the lines to
drop; lines themselves are never joined, and a line in very many documents is
probed in bounded pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.probing import probe_shards
from ledgersift.session import materialize

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 1 << 17
SPREAD = 2  # bits per key at each level
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)  # stands for a null doc_id: one document before all others


# --- lines ----------------------------------------------------------------------------------------


def line_digests(text: str, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """Per line 16 bytes that tell its key: blanks stripped, A-Z lowered; None for keys below ``least_chars``."""
    found = []
    for line in text.split("\n"):
        key = line.strip(BLANKS)
        # Of bytes, lower() changes A-Z only.
        found.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= least_chars else None)
    return found


# --- minimal perfect hash -------------------------------------------------------------------------


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys (two 64-bit words each) fall among ``size`` bits of a level."""
    x = words[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) ^ words[:, 1]
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_levels(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bits): levels of a minimal perfect hash of distinct keys; bits are packed, all levels in a row."""
    sizes, bits = [], []
    while len(words):
        size = SPREAD * len(words) + 1
        at = _spot(words, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words = words[~alone[at]]
    return np.array(sizes, np.int64), np.packbits(np.concatenate([*bits, np.zeros(0, bool)]))


def find_slots(words: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of every key of the hash; other keys get any slot or -1, so fingerprints must be compared."""
    flat = np.unpackbits(bits, count=int(sizes.sum())).astype(bool)
    before = np.cumsum(flat) - flat
    slots, todo, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(todo):
            break
        at = start + _spot(words[todo], level, size)
        hit = flat[at]
        slots[todo[hit]] = before[at[hit]]
        todo = todo[~hit]
        start += size
    return slots


# --- Spark jobs -----------------------------------------------------------------------------------


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 20), F.lit(shards))


def _line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, h1, h2): the distinct keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {d for d in line_digests(text, least_chars) if d}
                ids.extend([doc_id] * len(held))
                found.extend(held)
            words = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words[:, 0]), pa.array(words[:, 1])], ["id", "h1", "h2"]
            )

    return docs.select("id", "text").mapInArrow(run, "id long, h1 long, h2 long")


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard of (h1, h2, n, last): levels, fingerprints, counts and last holders in slot order."""

    def build(table: pa.Table) -> pa.Table:
        words = np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")])
        sizes, bits = build_levels(words)
        place = np.empty(len(words), np.int64)
        place[find_slots(words, sizes, bits)] = np.arange(len(words))
        blobs = {"sizes": sizes, "bits": bits, "prints": words[place, 1]}
        blobs |= {c: table.column(c).to_numpy()[place] for c in ("n", "last")}
        return pa.table({"shard": table.column("shard")[:1], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()}})

    schema = "shard long, sizes binary, bits binary, prints binary, n binary, last binary"
    return lines.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, schema)


def _probes(lines: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard the packed hashes and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, ids = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            words = np.column_stack([batch.column(i).to_numpy() for i in (1, 2)])
            order = np.argsort(shard, kind="stable")
            held, starts = np.unique(shard[order], return_index=True)
            for s, at in zip(held.tolist(), np.split(order, starts[1:]), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s]), pa.array([len(at)]), pa.array([words[at].tobytes()], pa.binary()),
                     pa.array([ids[at].tobytes()], pa.binary())], ["shard", "n", "words", "ids"],
                )

    return lines.withColumn("shard", _shard(shards)).mapInArrow(run, "shard long, n long, words binary, ids binary")


def _answer(least_docs: int):
    def answer(held: dict, asked: list[dict]) -> pa.RecordBatch:
        sizes, n, last = (np.frombuffer(held[c], np.int64) for c in ("sizes", "n", "last"))
        bits, prints = np.frombuffer(held["bits"], np.uint8), np.frombuffer(held["prints"], np.uint64)
        words = np.frombuffer(b"".join(a["words"] for a in asked), np.uint64).reshape(-1, 2)
        ids = np.frombuffer(b"".join(a["ids"] for a in asked), np.int64)
        slots = find_slots(words, sizes, bits)
        drop = (slots >= 0) & (prints[slots] == words[:, 1]) & (n[slots] >= least_docs) & (last[slots] != ids)
        words, ids = words[drop], ids[drop]
        order = np.argsort(ids, kind="stable")
        docs, starts = np.unique(ids[order], return_index=True)
        blobs = [words[at].tobytes() for at in np.split(order, starts[1:])] if len(docs) else []
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], ["id", "gone"])

    return answer


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept (the lines that stay, joined by line feeds).

    A line's key has its outer ASCII blanks stripped and A-Z lowered. A key of
    ``least_chars`` code points or more in ``least_docs`` documents or more (2 at least) stays only in
    the largest doc_id that holds it, there with all its lines. Null and empty
    texts are one empty line. Rows with one doc_id count as one document; null ids
    together are one document before all others. Other columns are ignored; an
    empty table gives no rows.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    texts = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    lines = materialize(_line_hashes(texts, least_chars))
    counted = materialize(
        lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where("n > 1")
    )
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    index = materialize(build_index(counted, shards))
    answers = probe_shards(index, materialize(_probes(lines, shards)), _answer(least_docs), "id long, gone binary")
    gone = answers.groupBy("id").agg(F.collect_list("gone").alias("gone"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                split = text.split("\n")
                if blobs:
                    bad = {b[i:i + 16] for b in blobs for i in range(0, len(b), 16)}
                    stay = [line for line, d in zip(split, line_digests(text, least_chars), strict=True) if d not in bad]
                else:
                    stay = split
                n_lines.append(len(split))
                n_dropped.append(len(split) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    joined = texts.join(gone, "id", "left").select("doc_id", "text", "gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(drop, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
