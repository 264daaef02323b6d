"""Removal of byte strings that an earlier document has, by prefix-free parsing.

Texts are parsed into phrases at the triggers of a rolling hash. A phrase and
the bytes that its last strings need form one word of the dictionary; the
parse of a document is its sequence of words. A word that an earlier document
also has settles all strings that start in it, which collapses repetitive text
at the cost of one entry per phrase. Only the first occurrences remain for the
finer step: their strings are looked at where a local minimum of the rolling
hash (every string of the given length has one) also occurs elsewhere, and
those strings are ordered across the corpus by hash, each group with the
smallest document that has it.

Three exchanges carry dictionary words, minima and strings between *chunks* (a
bounded number of texts dealt out by hash) and *buckets* (ranges of hash
values). Entries travel packed, one row per chunk and bucket, after repeats
inside the chunk are gone: a string that every document has is one entry per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.rolling import mixed, prefix_sums, sliding_min, span_hash, span_hashes, window_hash

WIDTH = 50
TRIGGER = 24
PHRASE = 128
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 1 << 19
SEED = 5
WORDS, MINIMA, STRINGS = 1, 2, 3
EXCHANGE = "kind int, chunk long, bucket long, keys binary, docs binary"
ANSWER = "kind int, chunk long, keys binary, docs binary"


class Parsed:
    """The documents of one batch as a byte array, with hashes of their strings.

    ``words_only`` leaves out what the strings need. Only the sums and the minima grow with every byte;
    each is given up by the step that needs it last.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int, trigger: int, phrase: int, words_only: bool) -> None:
        self.ids, self.texts, self.width = ids, texts, width
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sums = prefix_sums(data)
        grams = window_hash(self.sums, trigger)
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets[:-1]] = True
        cut[: len(grams)] |= (grams % np.uint64(phrase)) == 0
        self.starts = np.flatnonzero(cut[:-1])
        ends = np.append(self.starts[1:], len(data))
        owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.words = span_hash(self.sums, self.starts, np.minimum(ends + width - 1, self.offsets[owner + 1]), data)
        self.word_doc = ids[owner]
        n = max(0, len(data) - width + 1)
        self.minimum = sliding_min(grams, width - trigger + 1) if n and not words_only else np.zeros(0, np.uint64)
        if words_only:
            self.sums = None

    def begin(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle the words, given the smallest document of each: (minima, documents) of the runs of open strings.

        Kept are the ``open`` places, whose dictionary word no earlier document has, in runs of one minimum and one document.
        """
        self.settled = np.repeat(first < self.word_doc, np.diff(np.append(self.starts, self.offsets[-1])))
        for low, high in zip(self.offsets[:-1], self.offsets[1:]):
            self.settled[max(low, high - self.width + 1):high] = True
        self.open = np.flatnonzero(~self.settled).astype(np.int32 if len(self.settled) < 2**31 else np.int64)
        k = self.minimum[self.open]
        self.minimum = None
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        begun = np.searchsorted(self.open, self.offsets[:-1])
        fresh[begun[begun < len(k)]] = True
        self.runs = np.flatnonzero(fresh)
        self.run_keys = k[self.runs]
        return self.run_keys, self.documents(self.open[self.runs])

    def choose(self, shared: np.ndarray) -> np.ndarray:
        """Keep the open strings of the runs that are ``shared``; their hashes."""
        self.open = self.open[np.repeat(shared, np.diff(np.append(self.runs, len(self.open))))]
        code = mixed(span_hashes(self.sums, self.open, self.width) ^ np.uint64(0x5851F42D4C957F2D))
        self.sums = self.runs = self.run_keys = None
        return code

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The documents of ascending places."""
        cuts = np.searchsorted(places, self.offsets)
        return np.repeat(self.ids, np.diff(cuts))

    def gone(self, repeated: np.ndarray) -> np.ndarray:
        """The bytes that strings of earlier documents cover, given which of the chosen strings are repeated."""
        for low, high in zip(self.offsets[:-1], self.offsets[1:]):
            self.settled[max(low, high - self.width + 1):high] = False
        self.settled[self.open[repeated]] = True
        at = np.flatnonzero(self.settled)
        cover = np.zeros(self.offsets[-1] + 1, np.int64)
        cover[at] += 1
        cover[at + self.width] -= 1
        return np.cumsum(cover)[:-1] > 0


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal keys together, ascending; where each key's group begins in it)."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(fresh)


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the smallest document of each."""
    order, starts = _grouped(keys)
    return keys[order[starts]], np.minimum.reduceat(docs[order], starts) if len(keys) else docs


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, values.dtype)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[spot] == wanted, values[spot], default)


FAR = np.iinfo(np.int64).max


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers as their lowest bytes, as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    low = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the first one and the steps between them."""
    return int(keys[0]).to_bytes(8, "little") + _pack(np.diff(keys))


def unpack_keys(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob, "<u8", 1)
    return np.cumsum(np.concatenate([first, _unpack(blob[8:])]), dtype=np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Signed ids as the smallest one and the differences from it."""
    low = int(ids.min())
    return low.to_bytes(8, "little", signed=True) + _pack((ids - low).astype(np.uint64))


def unpack_ids(blob: bytes) -> np.ndarray:
    return _unpack(blob[8:]).astype(np.int64) + int.from_bytes(blob[:8], "little", signed=True)


class _Chunk:
    """What one chunk knows: its own smallest documents per key, and the answers from the buckets."""

    def __init__(self, texts: pa.Table, answers: pa.Table | None, options: dict) -> None:
        ids = texts.column("doc_id").to_numpy()
        raw = texts.column("text")
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        encoded = [(raw[int(i)].as_py() or "").encode() for i in order]
        self.answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if answers is not None:
            kinds = answers.column("kind").to_pylist()
            for kind in set(kinds):
                rows = [i for i, k in enumerate(kinds) if k == kind]
                keys = np.concatenate([unpack_keys(answers.column("keys")[i].as_py()) for i in rows])
                if kind == MINIMA:
                    docs = np.ones(len(keys), np.int64)
                else:
                    docs = np.concatenate([unpack_ids(answers.column("docs")[i].as_py()) for i in rows])
                self.answers[kind] = _smallest(keys, docs)
        self.batches: list[Parsed] = []
        start, size = 0, 0
        for i, text in enumerate(encoded):
            size += len(text)
            if size >= BATCH_BYTES or i + 1 == len(encoded):
                self.batches.append(Parsed(ids[start:i + 1], encoded[start:i + 1], **options, words_only=answers is None))
                start, size = i + 1, 0

    def _told(self, kind: int, keys: np.ndarray, default: int) -> np.ndarray:
        """What the buckets told of each key."""
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return _looked_up(*self.answers.get(kind, none), keys, default)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, smallest document of this chunk) of the dictionary words."""
        return _smallest(np.concatenate([p.words for p in self.batches]), np.concatenate([p.word_doc for p in self.batches]))

    def minima(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, 1 if two documents of this chunk have it) of the open strings."""
        own, found = self.words(), []
        for p in self.batches:
            first = np.minimum(_looked_up(*own, p.words, FAR), self._told(WORDS, p.words, FAR))
            found.append(p.begin(first))
        k, d = (np.concatenate(x) for x in zip(*found))
        order, starts = _grouped(k)
        k, d = k[order], d[order]
        if not len(k):
            return k, np.zeros(0, np.int64)
        return k[starts], (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)).astype(np.int64)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, smallest document of this chunk, whether an earlier document repeats each) of the open strings whose minimum
        occurs in another document too; the last in the order of the batches and places.
        """
        keys, several = self.minima()
        codes, docs = [], []
        for p in self.batches:
            shared = _looked_up(keys, several, p.run_keys, 0) > 0
            shared |= self._told(MINIMA, p.run_keys, 0) > 0
            codes.append(p.choose(shared))
            docs.append(p.documents(p.open))
        k, d = np.concatenate(codes), np.concatenate(docs)
        codes = docs = None
        order, starts = _grouped(k)
        if not len(k):
            return k, d, np.zeros(0, bool)
        k, sorted_docs = k[order][starts], d[order]
        low = np.minimum.reduceat(sorted_docs, starts)
        first = np.minimum(low, self._told(STRINGS, k, FAR))
        repeated = np.empty(len(d), bool)
        repeated[order] = np.repeat(first, np.diff(np.append(starts, len(d)))) < sorted_docs
        return k, low, repeated

    def cleaned(self):
        """The batches with the bytes that go."""
        repeated, at = self.strings()[2], 0
        for p in self.batches:
            yield p, p.gone(repeated[at:at + len(p.open)])
            at += len(p.open)


def _send(kind: int, chunk: int, keys: np.ndarray, docs: np.ndarray | None, buckets: int) -> pa.Table:
    """Entries packed by bucket; keys are ascending, and buckets are ranges of them."""
    edges = np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges.astype(np.uint64)), [len(keys)]])
    full = np.flatnonzero(np.diff(cuts))
    return pa.table({
        "kind": pa.array(np.full(len(full), kind), pa.int32()),
        "chunk": pa.array(np.full(len(full), chunk), pa.int64()),
        "bucket": pa.array(full, pa.int64()),
        "keys": pa.array([pack_keys(keys[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
        "docs": pa.array([b"" if docs is None else pack_ids(docs[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
    })


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk the keys of a bucket that other chunks have: with a smaller document, or (minima) at all."""
    kind = table.column("kind")[0].as_py()
    chunks = table.column("chunk").to_numpy()
    keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    docs = (
        np.zeros(len(flat), np.int64) if kind == MINIMA
        else np.concatenate([unpack_ids(d) for d in table.column("docs").to_pylist()])
    )
    order = np.argsort(flat, kind="stable")
    k, d, s = flat[order], docs[order], source[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    low = np.minimum.reduceat(d, starts)[group]
    told = (np.diff(np.append(starts, len(k)))[group] > 1) if kind == MINIMA else low < d
    k, low, s = k[told], low[told], s[told]
    back = np.argsort(s, kind="stable")
    k, low, s = k[back], low[back], s[back]
    cuts = np.searchsorted(s, np.arange(len(keys) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.table({
        "kind": pa.array(np.full(len(full), kind), pa.int32()),
        "chunk": pa.array(chunks[full], pa.int64()),
        "keys": pa.array([pack_keys(k[cuts[i]:cuts[i + 1]]) for i in full], pa.binary()),
        "docs": pa.array([b"" if kind == MINIMA else pack_ids(low[cuts[i]:cuts[i + 1]]) for i in full], pa.binary()),
    })


def _cleaned(p: Parsed, gone: np.ndarray) -> dict[str, list]:
    """Per document of a batch: sizes, removed bytes and runs, and the bytes that stay."""
    data = np.frombuffer(b"".join(p.texts), np.uint8)
    out: dict[str, list] = {"doc_id": p.ids.tolist(), "n_bytes": p.sizes.tolist(), "n_removed": [], "n_spans": [], "kept": []}
    for low, high, text in zip(p.offsets[:-1], p.offsets[1:], p.texts):
        mask = gone[low:high]
        removed = int(np.count_nonzero(mask))
        out["n_removed"].append(removed)
        out["n_spans"].append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(mask[0])) if removed else 0)
        out["kept"].append(data[low:high][~mask].tobytes() if removed else text)
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, digest_only: bool = False, chunk_bytes: int = CHUNK_BYTES,
                   trigger: int = TRIGGER, phrase: int = PHRASE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and ``kept`` (bytes) or, if asked, ``kept_sha256``.

    A byte goes if a string of ``width`` bytes covers it that also starts in a
    document with a smaller doc_id, judged on the given texts. Null texts are
    empty; texts shorter than ``width`` stay whole; rows with one doc_id do not
    repeat each other and come as often as they are given; rows without doc_id
    are taken as the last document. An empty table gives no rows; other columns
    are ignored. Strings are told apart by 64-bit hashes inside a range of
    hash values.
    """
    if not 0 < trigger < width:
        raise ValueError("the trigger must be shorter than the strings")
    options = {"width": width, "trigger": trigger, "phrase": phrase}
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    texts = docs.select(
        F.coalesce("doc_id", F.lit(int(FAR) - 1)).alias("doc_id"), "text"
    ).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(chunks)))

    def first_pass(table: pa.Table) -> pa.Table:
        keys, found = _Chunk(table, None, options).words()
        return _send(WORDS, table.column("chunk")[0].as_py(), keys, found, chunks)

    def second_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, _ = _Chunk(table, answers, options).minima()
        return _send(MINIMA, table.column("chunk")[0].as_py(), keys, None, chunks)

    def third_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, found, _ = _Chunk(table, answers, options).strings()
        return _send(STRINGS, table.column("chunk")[0].as_py(), keys, found, chunks)

    def last_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, answers, options)
        parts: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for p, gone in chunk.cleaned():
            for name, values in _cleaned(p, gone).items():
                parts[name] += [hashlib.sha256(v).hexdigest() for v in values] if digest_only and name == "kept" else values
        types = {"kept": pa.string() if digest_only else pa.binary()}
        return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in parts.items()})

    def asked(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_answer, ANSWER)

    grouped = texts.groupBy("chunk")
    words = asked(grouped.applyInArrow(first_pass, EXCHANGE))
    minima = asked(grouped.cogroup(words.groupBy("chunk")).applyInArrow(second_pass, EXCHANGE))
    strings = asked(grouped.cogroup(words.union(minima).groupBy("chunk")).applyInArrow(third_pass, EXCHANGE))
    told = words.union(minima).union(strings)
    kept = "kept_sha256 string" if digest_only else "kept binary"
    out = grouped.cogroup(told.groupBy("chunk")).applyInArrow(
        lambda a, b: last_pass(a, b).rename_columns(["doc_id", "n_bytes", "n_removed", "n_spans", kept.split(" ")[0]]),
        f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}",
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") < int(FAR) - 1, F.col("doc_id")))
