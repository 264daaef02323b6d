"""Exact deduplication against a minimal perfect hash of known digests.

The distinct digests of a history are dealt into bounded buckets by their
first bytes; each bucket gets a minimal perfect hash (displacements per small
group of keys) whose slots hold the full digest and the locator of the row
that stands for it. A lookup computes one slot and compares the whole digest,
so a foreign digest is recognised; foreign digests are grouped among
themselves. Buckets are rows of a table: building and looking up are grouped
Spark jobs over buckets, each of which has at most a few thousand digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_KEYS = 4096
GROUP_KEYS = 4
STRIDES = 1 << 14  # tried per group before the bucket gets another salt
NO_ID = 2**63 - 1  # stands for a null doc_id, which comes last
SPACES = " \t\n\x0b\x0c\r"

INDEX = (
    "bucket long, n int, strides binary, shifts binary, digests binary, locators binary, sizes binary, copies binary"
)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _keys(digests: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit numbers from the last 24 bytes of 32-byte digests (the first choose the bucket).

    With a salt they come from the digest of salt and digest.
    """
    if salt:
        head = salt.to_bytes(8, "big")
        rows = [hashlib.sha256(head + d.tobytes()).digest() for d in digests.reshape(-1, 32)]
        digests = np.frombuffer(b"".join(rows), np.uint8)
    words = digests.reshape(-1, 32).view(">u8")
    return words[:, 1].astype(np.uint64), words[:, 2].astype(np.uint64), words[:, 3].astype(np.uint64)


def _base(h2: np.ndarray, h3: np.ndarray, stride: np.ndarray | np.uint64, n: int) -> np.ndarray:
    """Slots before the shift. Every stride mixes all bits anew, so that no ``n`` makes strides repeat each other."""
    x = h2 ^ (h3 + stride * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(n)


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strides, shifts, slots): a minimal perfect hash of distinct digests.

    Keys fall into groups of about four. A group's keys go to the slots
    ``(mix(h2, h3, stride) + shift) mod n``; the largest groups choose first, and a
    single key simply shifts to the next free slot. Where a group finds no
    place, all keys are hashed again with the next salt, which stands before the strides.
    """
    salt = 0
    while (found := _displace(*_keys(digests, salt))) is None:
        salt += 1
    strides, shifts, slots = found
    return np.concatenate([np.array([salt], np.uint32), strides]), shifts, slots


def _displace(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(strides, shifts, slots), or None when a group fits nowhere."""
    n = len(h1)
    groups = max(1, -(-n // GROUP_KEYS))
    of = (h1 % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(groups + 1))
    strides, shifts = np.zeros(groups, np.uint32), np.zeros(groups, np.uint32)
    taken, slots, every = np.zeros(n, bool), np.zeros(n, np.int64), np.arange(n)
    free = 0
    for g in np.argsort(-(edges[1:] - edges[:-1]), kind="stable"):
        members = order[edges[g]:edges[g + 1]]
        if len(members) == 0:
            break
        if len(members) == 1:
            while taken[free]:
                free += 1
            base = int(_base(h2[members], h3[members], np.uint64(0), n)[0])
            shifts[g], slots[members[0]] = (free - base) % n, free
            taken[free] = True
            continue
        for stride in range(STRIDES):
            base = _base(h2[members], h3[members], np.array([stride], np.uint64), n).astype(np.int64)
            if len(np.unique(base)) < len(base):
                continue
            clear = ~taken[(base[:, None] + every) % n].any(axis=0)
            if clear.any():
                shift = int(np.argmax(clear))
                strides[g], shifts[g] = stride, shift
                slots[members] = (base + shift) % n
                taken[slots[members]] = True
                break
        else:
            return None
    return strides, shifts, slots


def find_slots(digests: np.ndarray, n: int, strides: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The slot each digest would have; whether it is there is for the caller to compare."""
    h1, h2, h3 = _keys(digests, int(strides[0]))
    g = (h1 % np.uint64(len(shifts))).astype(np.int64)
    base = _base(h2, h3, strides[1 + g].astype(np.uint64), n)
    return ((base + shifts[g].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _packed(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(v) for v in values), np.uint8).reshape(-1, 32)


def _best(df: DataFrame) -> DataFrame:
    """Per digest the row to keep (most code points, then smallest id) and the number of rows."""
    # Partial aggregation leaves one row per digest and task before the shuffle.
    return df.groupBy("digest").agg(
        F.max(F.struct(F.col("size").alias("size"), (-F.col("doc_id")).alias("minus"))).alias("top"),
        F.count(F.lit(1)).alias("copies"),
    ).select("digest", (-F.col("top.minus")).alias("doc_id"), F.col("top.size").alias("size"), "copies")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint"), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index of a history (doc_id, digest, size): one row per bucket. An empty history has no rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _packed(pdf["digest"])
        strides, shifts, slots = build_hash(digests)
        place = np.empty(len(slots), np.int64)
        place[slots] = np.arange(len(slots))
        return pd.DataFrame({
            "bucket": [pdf["bucket"].iloc[0]], "n": [len(slots)], "strides": [strides.tobytes()],
            "shifts": [shifts.tobytes()], "digests": [digests[place].tobytes()],
            **{name: [pdf[column].to_numpy(np.int64)[place].tobytes()]
               for name, column in (("locators", "doc_id"), ("sizes", "size"), ("copies", "copies"))},
        })

    return _best(history).withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def look_up(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Groups of equal texts over history and batch: (digest, keep_id, group_size, known).

    ``known`` tells whether the digest is in the history. Members join the slot
    whose full digest equals theirs, the others stand for themselves.
    """
    schema = "digest string, keep_id long, group_size long, known boolean"

    def probe(built: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(asked), bool)
        parts = []
        if len(built):
            row = built.iloc[0]
            held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            locators, sizes, copies = (np.frombuffer(row[c], np.int64).copy() for c in ("locators", "sizes", "copies"))
            if len(asked):
                digests = _packed(asked["digest"])
                slots = find_slots(
                    digests, row["n"], np.frombuffer(row["strides"], np.uint32), np.frombuffer(row["shifts"], np.uint32)
                )
                found = (held[slots] == digests).all(axis=1)
                at, size, ids = slots[found], asked["size"].to_numpy()[found], asked["doc_id"].to_numpy()[found]
                better = (size > sizes[at]) | ((size == sizes[at]) & (ids < locators[at]))
                locators[at[better]] = ids[better]
                copies[at] += asked["copies"].to_numpy()[found]
            parts.append(pd.DataFrame({
                "digest": [d.tobytes().hex() for d in held], "keep_id": locators, "group_size": copies, "known": True,
            }))
        rest = asked[~found]
        parts.append(pd.DataFrame({
            "digest": rest["digest"], "keep_id": rest["doc_id"], "group_size": rest["copies"], "known": False,
        }))
        return pd.concat([p for p in parts if len(p)] or parts[-1:], ignore_index=True)

    asked = _best(batch).withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(probe, schema)


def exact_groups(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    Texts are equal when they are the same without ASCII white space; null and
    empty texts form one group. Of equal texts the one with the most code
    points stays, then the smallest doc_id. ``is_history`` tells which rows
    are known already (default: the lower half of the doc_id range); the index is
    built on them and the rest is looked up. Repeated rows with one doc_id are
    reported as often as they come and are all kept when it is the keeper's id.
    An empty table gives no rows; other columns are ignored.
    """
    if is_history is None:
        ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        middle = 0 if ends["a"] is None else ends["a"] // 2 + ends["b"] // 2
        is_history = F.col("doc_id") <= F.lit(middle)
    rows = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.sha2(normalised(F.col("text")), 256).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(is_history, F.lit(False)).alias("old"),
    )
    buckets = max(1, -(-docs.count() // BUCKET_KEYS))
    index = build_index(rows.where("old").drop("old"), buckets)
    groups = look_up(index, rows.where("not old").drop("old"), buckets)
    given = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return rows.select("doc_id", "digest").join(groups, "digest").select(
        given("doc_id"), given("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "known",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, in its columns: one per group of equal texts."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    named = docs.withColumn("_text", F.sha2(normalised(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_kept"))
    return named.join(kept.distinct(), same, "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
