"""Alignment of two tokenizers over the same bytes, by fragments that compose.

A text is cut into byte ranges. The tokens that end in a range make a
fragment: an open prefix (tokens up to the first byte offset where tokens of
both sides end), closed groups, and an open suffix (tokens after the last such
offset). Fragments of neighbouring ranges compose associatively, so that the ranges of
a very long text are read by many tasks and joined by a tree of grouped jobs.
Inside a group, the tokens of both sides that share a byte are links. How many
documents hold an id pair linked is counted over the corpus and looked up in
sharded arrays by packed probes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.probing import arrow_schema, probe_shards
from ledgersift.session import materialize, work_partitions

TOKENIZERS = "/opt/tokenizers"
CHUNK_CHARS = 1 << 15
FAN_IN = 8
SHARD_PAIRS = 1 << 18
#: Fixed value: the published word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space exhaust the fast matcher; such pieces take the slower encoder, with equal results.
LONG_BLANK = re.compile(r"\s{2000}")


# --- vocabularies ---------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes as they are, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both encoders and the bytes of their tokens, read from files on the worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding(a_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [_piece_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.wide = len(self.a_bytes) * len(self.b_bytes) >= 1 << 32
        self.shown = [[f"{i}{end}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for end in ",|;"]

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        return made

    def encode_a(self, text: str) -> list[int]:
        if LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def key_type(self) -> np.dtype:
        return np.dtype(np.uint64 if self.wide else np.uint32)


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@functools.lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One copy per worker process."""
    return Vocabularies(a_path, b_path)


# --- fragments ------------------------------------------------------------------------------------


def _no(dtype=np.int64) -> np.ndarray:
    return np.zeros(0, dtype)


@dataclass
class Side:
    """Tokens of both sides with the byte offsets of their ends."""

    a: np.ndarray = field(default_factory=_no)
    a_end: np.ndarray = field(default_factory=_no)
    b: np.ndarray = field(default_factory=_no)
    b_end: np.ndarray = field(default_factory=_no)

    def __add__(self, other: Side) -> Side:
        return Side(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "a_end", "b", "b_end")))

    def __bool__(self) -> bool:
        return bool(len(self.a) or len(self.b))


@dataclass
class Fragment:
    """Tokens that end in one byte range. ``closed`` tells whether a common end was seen; until then all is prefix."""

    valid: bool = True
    closed: bool = False
    prefix: Side = field(default_factory=Side)
    suffix: Side = field(default_factory=Side)
    shown: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    keys: np.ndarray = field(default_factory=_no)
    times: np.ndarray = field(default_factory=_no)


def _closed(voc: Vocabularies, side: Side, cuts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """(shown groups, pair keys, times, links) of whole groups that end at ``cuts``."""
    ga, gb = np.searchsorted(cuts, side.a_end), np.searchsorted(cuts, side.b_end)
    a_before, b_upto = np.cumsum(np.bincount(ga, minlength=len(cuts))), np.cumsum(np.bincount(gb, minlength=len(cuts)))
    order = np.empty(len(side.a) + len(side.b), np.int64)
    ends = np.empty(len(order), np.int64)
    at_a = np.arange(len(side.a)) + np.concatenate([[0], b_upto])[ga]
    at_b = np.arange(len(side.b)) + a_before[gb]
    order[at_a], order[at_b] = side.a, side.b
    ends[at_a] = np.where(cuts[ga] == side.a_end, 1, 0)
    ends[at_b] = np.where(cuts[gb] == side.b_end, 2, 0)
    size = len(voc.shown[0])
    flat = _flat_shown(voc)
    shown = b"".join(map(flat.__getitem__, (order + ends * size).tolist()))[:-1]
    # Between two neighbouring ends lies one token of each side: one link each.
    every = np.sort(np.concatenate([side.a_end, side.b_end]), kind="stable")
    every = every[np.concatenate([every[1:] != every[:-1], [True]])]
    pair = side.a[np.searchsorted(side.a_end, every)] * len(voc.b_bytes) + side.b[np.searchsorted(side.b_end, every)]
    keys, times = np.unique(pair, return_counts=True)
    return shown, keys, times.astype(np.int64), len(every)


@functools.lru_cache(maxsize=2)
def _flat_shown(voc: Vocabularies) -> list[bytes]:
    return [*voc.shown[0], *voc.shown[1], *voc.shown[2]]


def make_fragment(voc: Vocabularies, side: Side, valid: bool = True) -> Fragment:
    """The fragment of the tokens that end in one range."""
    cuts = np.intersect1d(side.a_end, side.b_end, assume_unique=True)
    made = Fragment(valid=valid, n_a=len(side.a), n_b=len(side.b))
    if not len(cuts):
        made.prefix = side
        return made
    first, last = cuts[0], cuts[-1]
    a0, a1 = np.searchsorted(side.a_end, [first, last], side="right")
    b0, b1 = np.searchsorted(side.b_end, [first, last], side="right")
    part = lambda i, j, k, m: Side(side.a[i:j], side.a_end[i:j], side.b[k:m], side.b_end[k:m])
    made.closed, made.prefix = True, part(0, a0, 0, b0)
    made.suffix = part(a1, len(side.a), b1, len(side.b))
    if len(cuts) > 1:
        made.shown, made.keys, made.times, made.n_links = _closed(voc, part(a0, a1, b0, b1), cuts[1:])
        made.n_groups = len(cuts) - 1
    return made


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts added up."""
    keys = np.concatenate([p[0] for p in parts])
    times = np.concatenate([p[1] for p in parts])
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, times)
    return found.astype(np.int64), total


def compose(voc: Vocabularies, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with the empty fragment as neutral element."""
    made = Fragment(
        valid=left.valid and right.valid, closed=left.closed or right.closed,
        n_a=left.n_a + right.n_a, n_b=left.n_b + right.n_b,
        n_groups=left.n_groups + right.n_groups, n_links=left.n_links + right.n_links,
    )
    shown, pairs = [left.shown], [(left.keys, left.times), (right.keys, right.times)]
    made.prefix, made.suffix = left.prefix, left.suffix + right.prefix
    if not left.closed:
        made.prefix, made.suffix = left.prefix + right.prefix, right.suffix
    elif right.closed:
        middle = left.suffix + right.prefix
        text, keys, times, links = _closed(voc, middle, middle.a_end[-1:])
        shown.append(text)
        pairs.append((keys, times))
        made.n_groups, made.n_links = made.n_groups + 1, made.n_links + links
        made.suffix = right.suffix
    shown.append(right.shown)
    made.shown = b";".join(s for s in shown if s)
    made.keys, made.times = _joined(pairs)
    return made


def finish(voc: Vocabularies, whole: Fragment) -> Fragment:
    """The groups of a whole text: its prefix is a group too, and nothing may stay open."""
    if not whole.valid or not whole.closed or whole.suffix:
        return Fragment(valid=False)
    text, keys, times, links = _closed(voc, whole.prefix, whole.prefix.a_end[-1:])
    whole.shown = b";".join(s for s in (text, whole.shown) if s)
    whole.keys, whole.times = _joined([(keys, times), (whole.keys, whole.times)])
    whole.n_groups, whole.n_links, whole.prefix = whole.n_groups + 1, whole.n_links + links, Side()
    return whole


# --- cutting texts into ranges --------------------------------------------------------------------


def _safe_before(text: str, at: int) -> int:
    """The last place up to ``at`` where a single blank stands between two words, else 0: both encoders start a token there."""
    found = text.rfind(" ", 0, at + 1)
    while found > 0:
        if found + 1 < len(text) and not text[found - 1].isspace() and not text[found + 1].isspace():
            return found
        found = text.rfind(" ", 0, found)
    return 0


def _safe_after(text: str, at: int) -> int:
    """The first such place from ``at`` on, else the end."""
    found = text.find(" ", max(at, 1))
    while found >= 0:
        if found + 1 < len(text) and not text[found - 1].isspace() and not text[found + 1].isspace():
            return found
        found = text.find(" ", found + 1)
    return len(text)


def cut_ranges(text: str, chars: int) -> Iterator[tuple[str, int, int, int]]:
    """(context, its first byte, from, to): the tokens of ``context`` that end in (from, to] belong to the range.

    Offsets count the bytes of blank + text. Contexts start and end where both
    encoders start a token, so that they are encoded as in the whole text. A
    text without such places is one context for all its ranges, encoded once as a single range.
    """
    spots = list(range(0, len(text), chars))
    edges = [0]
    whole = " " + text
    starts = [(max(0, _safe_before(whole, s)), _safe_after(whole, min(s + chars, len(whole) - 1)) if s + chars < len(text) else len(whole)) for s in spots]
    if any(b - a > 8 * chars for a, b in starts):
        size = len(whole.encode())
        yield whole, 0, 0, size
        return
    at_byte, done = 0, 0
    for k, s in enumerate(spots):
        stop = len(whole) if k + 1 == len(spots) else s + chars
        size = len(whole[s:stop].encode())
        edges.append(edges[-1] + size)
        a, b = starts[k]
        at_byte += len(whole[done:a].encode())
        done = a
        yield whole[a:b], at_byte, edges[-2], edges[-1]


def read_range(voc: Vocabularies, context: str, first: int, start: int, stop: int) -> Fragment:
    """Encode one context (it starts with a blank) and keep the tokens that end in (start, stop]."""
    raw = context.encode()
    if not raw:
        return Fragment(valid=False)
    found = voc.pieces.encode(context[1:])
    a, b = np.array(voc.encode_a(context), np.int64), np.array(found, np.int64)
    a_end, b_end = np.cumsum(voc.a_len[a]) + first, np.cumsum(voc.b_len[b]) + first
    # Byte-level tokens are pieces of the text itself, so that they can only leave bytes out.
    if not len(a) or a_end[-1] != first + len(raw) or b"".join(map(voc.b_bytes.__getitem__, found)) != raw:
        return Fragment(valid=False)
    i, j = np.searchsorted(a_end, [start, stop], side="right")
    k, m = np.searchsorted(b_end, [start, stop], side="right")
    return make_fragment(voc, Side(a[i:j], a_end[i:j], b[k:m], b_end[k:m]))


# --- Spark jobs -----------------------------------------------------------------------------------

_SIDES = ("a", "a_end", "b", "b_end")
FRAGMENT = (
    "row long, doc_id long, k int, n int, valid boolean, closed boolean, n_a long, n_b long, n_groups long, n_links long, "
    + "shown binary, keys binary, times binary, "
    + ", ".join(f"{p}_{c} binary" for p in ("prefix", "suffix") for c in _SIDES)
)
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_pairs int, keys binary, times binary"
)
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(values: np.ndarray) -> bytes:
    """Counts in the narrowest of three widths, which the first byte tells."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _to_row(of: dict, k: int, n: int, f: Fragment) -> dict:
    held = {"row": of["row"], "doc_id": of["doc_id"], "k": k, "n": n, "valid": f.valid, "closed": f.closed, "shown": f.shown,
            "keys": f.keys.tobytes(), "times": f.times.tobytes(), **{c: getattr(f, c) for c in _COUNTS}}
    for p in ("prefix", "suffix"):
        held |= {f"{p}_{c}": getattr(getattr(f, p), c).tobytes() for c in _SIDES}
    return held


def _from_row(held: dict) -> Fragment:
    array = lambda c: np.frombuffer(held[c], np.int64)
    return Fragment(
        valid=held["valid"], closed=held["closed"], shown=held["shown"], keys=array("keys"), times=array("times"),
        **{p: Side(*(array(f"{p}_{c}") for c in _SIDES)) for p in ("prefix", "suffix")}, **{c: held[c] for c in _COUNTS},
    )


def _aligned_row(voc: Vocabularies, of: dict, whole: Fragment) -> dict:
    done = finish(voc, whole)
    return {"row": of["row"], "doc_id": of["doc_id"],
            "groups_sha256": hashlib.sha256(done.shown).hexdigest() if done.valid else "",
            "n_pairs": len(done.keys), "keys": done.keys.astype(voc.key_type()).tobytes(),
            "times": _packed(done.times), **{c: getattr(done, c) for c in _COUNTS}}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(schema))


def _ranges(docs: DataFrame, chars: int) -> DataFrame:
    """One row per range; texts of up to ``chars`` characters are one range, empty ones a range without context."""
    names = ("row", "doc_id", "k", "n", "context", "first", "start", "stop")
    schema = "row long, doc_id long, k int, n int, context string, first long, start long, stop long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(cut_ranges(text, chars)) if text else [("", 0, 0, 0)]
                for k, (context, *at) in enumerate(found):
                    rows.append(dict(zip(names, (row, doc_id, k, len(found), context, *at), strict=True)))
                    size += len(context)
                    if size > 1 << 23:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    return docs.mapInArrow(run, schema)


def align_rows(docs: DataFrame, a_path: str, b_path: str, chars: int = CHUNK_CHARS, fan_in: int = FAN_IN) -> DataFrame:
    """Alignments of (row, doc_id, text), ``row`` unique: one ALIGNED row each, in written tables."""
    spark = docs.sparkSession
    parts = work_partitions(spark, 1 << 30)
    either = pa.schema([(name, pa.struct(arrow_schema(schema))) for name, schema in (("fragment", FRAGMENT), ("whole", ALIGNED))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(a_path, b_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(start, 256).to_pylist():
                    made = read_range(voc, r["context"], r["first"], r["start"], r["stop"])
                    # A text of one range is done here; only longer ones carry their groups on.
                    held = {"fragment": None, "whole": None}
                    if r["n"] == 1:
                        held["whole"] = _aligned_row(voc, r, made)
                    else:
                        held["fragment"] = _to_row(r, r["k"], r["n"], made)
                    rows.append(held)
                yield pa.RecordBatch.from_pylist(rows, schema=either)

    def join(table: pa.Table) -> pa.Table:
        voc = vocabularies(a_path, b_path)
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        made = functools.reduce(lambda x, y: compose(voc, x, y), map(_from_row, rows))
        first = rows[0]
        return pa.Table.from_batches([_batch([_to_row(first, first["k"] // fan_in, -(-first["n"] // fan_in), made)], FRAGMENT)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([_aligned_row(voc, r, _from_row(r))], ALIGNED)

    encoded = materialize(
        _ranges(docs, chars).repartition(parts, "row", "k")
        .mapInArrow(encode, f"fragment struct<{_nested(FRAGMENT)}>, whole struct<{_nested(ALIGNED)}>")
    )
    whole = encoded.where("whole is not null").select("whole.*")
    pending = encoded.where("fragment is not null").select("fragment.*")
    most = pending.agg(F.max("n")).first()[0]
    if most is None:
        return whole
    while most > 1:
        pending = pending.groupBy("row", F.floor(F.col("k") / fan_in)).applyInArrow(join, FRAGMENT)
        most = -(-most // fan_in)
    return whole.unionByName(materialize(pending.mapInArrow(close, ALIGNED)))


def _nested(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split() for c in schema.split(", ")))


def pair_counts(aligned: DataFrame, key_bytes: int) -> DataFrame:
    """(key, n): in how many documents each id pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [b for b in batch.column(0).to_pylist() if b]
            if blobs:
                keys, n = np.unique(np.frombuffer(b"".join(blobs), f"<u{key_bytes}"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return aligned.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _link_sums(aligned: DataFrame, counts: DataFrame, key_bytes: int, b_size: int) -> DataFrame:
    """(row, n_best, count_sum) over the links of each document."""
    best = counts.groupBy(F.expr(f"key div {b_size}").alias("a")).agg(F.max("n").alias("top"))
    marked = counts.withColumn("a", F.expr(f"key div {b_size}")).join(best, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    shards = max(1, -(-counts.count() // SHARD_PAIRS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard_of(batch.column("key").to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        return pa.table({
            "shard": table.column("shard")[:1], "held": pa.array([table.column("key").to_numpy().tobytes()], pa.binary()),
            "counts": pa.array([table.column("n").to_numpy().tobytes()], pa.binary()),
            "tops": pa.array([table.column("best").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
        })

    arrays = (
        marked.mapInArrow(build, "shard long, key long, n long, best boolean")
        .groupBy("shard").applyInArrow(pack, "shard long, held binary, counts binary, tops binary")
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            sizes = batch.column(1).to_numpy().astype(np.int64)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), f"<u{key_bytes}")
            times = np.concatenate([_unpacked(t) for t in batch.column(3).to_pylist()] or [_no()])
            of = np.repeat(np.arange(len(rows)), sizes)
            shard = _shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                at = order[edges[s]:edges[s + 1]]
                # Blobs of bounded size, so that a frequent shard can be cut.
                for part in np.array_split(at, -(-len(at) // (1 << 16)) or 1):
                    if len(part):
                        runs, n = np.unique(of[part], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s]), pa.array([len(part)]), pa.array([keys[part].tobytes()], pa.binary()),
                             pa.array([_packed(times[part])], pa.binary()), pa.array([rows[runs].tobytes()], pa.binary()),
                             pa.array([n.astype(np.int64).tobytes()], pa.binary())],
                            ["shard", "n", "keys", "times", "rows", "runs"],
                        )

    probes = materialize(
        aligned.where("n_pairs > 0").select("row", "n_pairs", "keys", "times")
        .mapInArrow(ask, "shard long, n long, keys binary, times binary, rows binary, runs binary")
    )

    def answer(held: dict, asked: list[dict]) -> pa.RecordBatch:
        known, counts, tops = (np.frombuffer(held[c], np.int64) for c in ("held", "counts", "tops"))
        rows, best, total = [], [], []
        for probe in asked:
            times = _unpacked(probe["times"])
            at = np.searchsorted(known, np.frombuffer(probe["keys"], f"<u{key_bytes}").astype(np.int64))
            runs = np.frombuffer(probe["runs"], np.int64)
            starts = np.concatenate([[0], np.cumsum(runs)[:-1]])
            rows.append(np.frombuffer(probe["rows"], np.int64))
            best.append(np.add.reduceat(times * tops[at], starts))
            total.append(np.add.reduceat(times * counts[at], starts))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (rows, best, total)], ["row", "n_best", "count_sum"])

    sums = probe_shards(materialize(arrays), probes, answer, "row long, n_best long, count_sum long")
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokens(
    docs: DataFrame, a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model",
    chars: int = CHUNK_CHARS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both vocabulary files must lie at the given paths on every worker. A null
    or empty text, or one whose tokens do not give back its bytes, has zeros and
    ''. Each row is a document of its own, whatever its doc_id; null ids stay null. Other
    columns are ignored; an empty table gives no rows. A text longer than ``chars`` characters
    is read in ranges by several tasks, unless it lacks places to cut; any ``chars``
    and ``fan_in`` (2 at least) give the same rows.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = align_rows(keyed, a_path, b_path, chars, fan_in)
    wide, b_size = _sizes(a_path, b_path)
    key_bytes = 8 if wide else 4
    sums = _link_sums(found, materialize(pair_counts(found, key_bytes)), key_bytes, b_size)
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*_COUNTS, "n_best", "count_sum")]
    base = found.select("row", "doc_id", *_COUNTS, "groups_sha256")
    return base.join(sums, "row", "left").select("doc_id", *numbers, "groups_sha256")


def _sizes(a_path: str, b_path: str) -> tuple[bool, int]:
    """Whether pair keys need 64 bits, and the number of B ids; read from the files on the driver."""
    if not os.path.exists(a_path) or not os.path.exists(b_path):
        raise FileNotFoundError(f"vocabulary files {a_path} and {b_path}")
    voc = vocabularies(a_path, b_path)
    return voc.wide, len(voc.b_bytes)
