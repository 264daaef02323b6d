"""Hard negatives by angular triangle filtering and exact integer scores.

Every vector is stored with its integer components, its norm and its angles to
a few reference directions. The triangle inequality on the sphere bounds the
angle of two vectors by their angles to one reference; times the norms this
bounds their inner product. Rows are kept in windows (one label, one nearest reference,
neighbouring angles); only windows whose bounds overlap the scores asked for are
scored, in exact integers.

Anchors and rows are both tables: blocks of anchors meet slices of rows in grouped
tasks, and each task returns at most a few rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.probing import arrow_schema
from ledgersift.session import materialize, work_partitions

REFERENCES = 16
SAMPLE_ROWS = 2048  # rows among which the reference directions are chosen
ANCHOR_BLOCK = 2048
SLICE_ROWS = 1 << 16
WINDOW_ROWS = 32
BATCH = 32  # anchors scored together
SAFE_ANGLE = 1e-7  # more than the rounding of an arc cosine
EXACT = 1 << 53
LARGEST = 1 << 62


# --- vectors and bounds ---------------------------------------------------------------------------


def _padded(rows: list[list[int]], width: int) -> np.ndarray:
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles): a right angle to every reference stands for the zero vector, whose scores are 0 anyway."""
    x = vectors.astype(np.float64)
    width = min(x.shape[1], references.shape[1])
    norms = np.sqrt((x * x).sum(axis=1))
    cosine = (x[:, :width] @ references[:, :width].T) / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosine, -1, 1))


def choose_references(vectors: np.ndarray, count: int) -> np.ndarray:
    """Directions far from one another among the given vectors: each next one is the least covered."""
    x = vectors.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    x = x[norms > 0] / norms[norms > 0][:, None]
    chosen, near = [], np.full(len(x), -2.0)
    for _ in range(min(count, len(x))):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-9:
            break
        chosen.append(x[at])
        near = np.maximum(near, x @ x[at])
    return np.array(chosen).reshape(len(chosen), vectors.shape[1])


def score_bounds(
    norms: np.ndarray, angles: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each vector (rows) with each window (columns).

    A window has per reference its least and greatest angle (``low``, ``high``) and
    the least and greatest norm of its rows. For every reference r the angle of
    the two vectors is at least the distance of their angles to r, and at most
    their sum, or what is left of the full circle. Bounds are widened beyond rounding.
    """
    near, far = np.zeros((len(norms), len(least))), np.full((len(norms), len(least)), np.pi)
    for r in range(angles.shape[1]):
        a = angles[:, r:r + 1]
        near = np.maximum(near, np.maximum(a - high[:, r], low[:, r] - a))
        # The sum may pass a half circle, where the other way round is shorter.
        up, down = a + high[:, r], a + low[:, r]
        far = np.minimum(far, np.where(up <= np.pi, up, np.where(down >= np.pi, 2 * np.pi - down, np.pi)))
    top, bottom = np.cos(np.clip(near - SAFE_ANGLE, 0, np.pi)), np.cos(np.clip(far + SAFE_ANGLE, 0, np.pi))
    n = norms[:, None]
    upper = top * n * np.where(top >= 0, most, least)
    lower = bottom * n * np.where(bottom >= 0, least, most)
    slack = 1 + 1e-9 * n * most
    return lower - slack, upper + slack


@dataclass
class Anchors:
    """Anchors that are looked at together."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


class Windows:
    """Rows of one slice in windows of one label, one nearest reference and neighbouring angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        cell = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(ids), np.int64)
        own = angles[np.arange(len(ids)), cell] if angles.shape[1] else np.zeros(len(ids))
        order = np.lexsort((own, cell, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        group = np.flatnonzero(np.diff(self.labels, prepend=self.labels[:1] - 1) | np.diff(cell[order], prepend=-1))
        ends = np.append(group[1:], len(ids))
        starts = np.concatenate([np.arange(s, e, WINDOW_ROWS) for s, e in zip(group, ends, strict=True)] or [np.zeros(0, np.int64)])
        self.starts, self.ends = starts, np.append(starts[1:], len(ids))
        if len(starts):
            n, a = norms[order], angles[order]
            self.least, self.most = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
            self.low, self.high = np.minimum.reduceat(a, starts, axis=0), np.maximum.reduceat(a, starts, axis=0)
            self.label = self.labels[starts]

        self.floats = self.vectors.astype(np.float64)
        self.top = float(np.abs(self.floats).max(initial=0))

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer inner products; floats serve where no sum can leave the integers that they hold exactly."""
        if np.abs(anchors.astype(np.float64)).max(initial=0) * self.top * max(1, anchors.shape[1]) < EXACT:
            return (anchors.astype(np.float64) @ self.floats[rows].T).astype(np.int64)
        limit = 2**63 - 1
        return np.clip(anchors.astype(object) @ self.vectors[rows].astype(object).T, -limit, limit).astype(np.int64)

    def rows_of(self, which: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[w], self.ends[w]) for w in which] or [np.zeros(0, np.int64)])


def _first(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` first rows: higher scores, then smaller ids."""
    if len(scores) > 8 * count:
        cut = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:count]]
    return np.lexsort((ids, -scores))[:count]


def same_label_best(windows: Windows, batch: Anchors, upper: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per anchor (ids, scores) of the first ``count`` other rows of its label.

    The windows with the highest bounds give a floor; only windows whose bound reaches it are scored.
    """
    mine = windows.label[None, :] == batch.labels[:, None]
    need = np.zeros(len(windows.starts), bool)
    for i in range(len(batch.ids)):
        some = np.flatnonzero(mine[i])
        some = some[np.argsort(-upper[i, some], kind="stable")]
        held = np.cumsum(windows.ends[some] - windows.starts[some])
        first = some[:np.searchsorted(held, 2 * count + 1) + 1]
        rows = windows.rows_of(first)
        rows = rows[windows.ids[rows] != batch.ids[i]]
        scores = windows.scores(batch.vectors[i:i + 1], rows)[0]
        if len(scores) >= count:
            floor = np.partition(scores, len(scores) - count)[len(scores) - count]
            some = some[upper[i, some] >= floor]
        need[some] = True
    rows = windows.rows_of(np.flatnonzero(need))
    scores = windows.scores(batch.vectors, rows)
    found = []
    for i in range(len(batch.ids)):
        fit = np.flatnonzero((windows.labels[rows] == batch.labels[i]) & (windows.ids[rows] != batch.ids[i]))
        keep = fit[_first(scores[i, fit], windows.ids[rows[fit]], count)]
        found.append((windows.ids[rows[keep]], scores[i, keep]))
    return found


def other_label_between(
    windows: Windows, batch: Anchors, lower: np.ndarray, upper: np.ndarray, asked: list[list[int]], least: int, count: int
) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per anchor and positive score p in ``asked``: (ids, scores) of the first rows with least * p <= 100 * score <= 100 * p.

    Only windows whose bounds overlap the scores asked for are read.
    """
    low = np.array([min((least * p / 100 for p in a), default=np.inf) for a in asked])
    high = np.array([max(a, default=-np.inf) for a in asked], np.float64)
    other = windows.label[None, :] != batch.labels[:, None]
    need = (other & (upper >= low[:, None]) & (lower <= high[:, None])).any(axis=0)
    rows = windows.rows_of(np.flatnonzero(need))
    scores = windows.scores(batch.vectors, rows)
    found = []
    for i, positives in enumerate(asked):
        mine = scores[i]
        other_rows = windows.labels[rows] != batch.labels[i]
        held = []
        for p in positives:
            # Whole numbers on both sides; a score times 100 may leave 64 bits, a quotient does not.
            fit = np.flatnonzero(other_rows & (mine >= -(-least * p // 100)) & (mine <= p))
            keep = fit[_first(mine[fit], windows.ids[rows[fit]], count)]
            held.append((windows.ids[rows[keep]], mine[keep]))
        found.append(held)
    return found


# --- Spark jobs -----------------------------------------------------------------------------------

_KEYS = ("id", "label", "vector", "norm", "angles")
INDEX = "id long, label long, vector array<long>, is_anchor boolean, norm double, angles array<double>"


def usable_rows(table: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vector, is_anchor): rows with id, label and finite components, as integers."""
    x, limit = F.col(vector_col).cast("array<double>"), F.lit(float(LARGEST))
    good = (
        F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    )
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(scale)), -limit), limit)))
    return table.where(good).select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )


def fit_references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Reference directions from at most ``sample`` rows, chosen by a hash of the id; all rows are indexed."""
    taken = rows.select("vector").orderBy(F.xxhash64("id", "vector")).limit(sample).toArrow().column(0).to_pylist()
    if not taken:
        return np.zeros((0, 1))
    return choose_references(_padded(taken, max(1, *map(len, taken))), count)


def index_rows(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows with their norms and angles to the references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = batch.column(2).to_pylist()
                norms, angles = angles_to(_padded(held, max(1, *map(len, held))), references)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(norms), pa.array(list(angles), pa.list_(pa.float64()))],
                    [*batch.schema.names, "norm", "angles"],
                )

    return rows.mapInArrow(run, INDEX)


def _arrays(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    angles = table.column("angles").to_pylist()
    return (
        table.column("id").to_numpy(), table.column("label").to_numpy(), _padded(table.column("vector").to_pylist(), width),
        table.column("norm").to_numpy(), np.array(angles, np.float64).reshape(len(angles), -1),
    )


def _meet(anchors: DataFrame, index: DataFrame, slices: int, blocks: int, visit, schema: str) -> DataFrame:
    """Every block of anchors meets every slice of rows in one task."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            width = max(max(map(len, t.column("vector").to_pylist())) for t in (left, right))
            windows = Windows(*_arrays(right, max(1, width)))
            ids, labels, vectors, norms, angles = _arrays(left, max(1, width))
            near = np.lexsort((angles.argmin(axis=1), labels)) if angles.shape[1] else np.arange(len(ids))
            asked, keys = left.column("asked").to_pylist(), left.column("anchor").to_pylist()
            for at in np.array_split(near, -(-len(near) // BATCH)):
                batch = Anchors(ids[at], labels[at], vectors[at])
                bounds = score_bounds(norms[at], angles[at], windows.least, windows.most, windows.low, windows.high)
                rows += visit(windows, batch, *bounds, [keys[i] for i in at], [asked[i] or [] for i in at])
        return pa.Table.from_pylist(rows, schema=arrow_schema(schema))

    left = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(run, schema)


def mine_hard_negatives(
    table: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256, references: int = REFERENCES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product.
    Rows where ``is_anchor`` holds are anchors, ``label`` is a whole number; both are
    columns of ``table``. An anchor's positives are its first ``positives`` rows of equal
    label and other id; for each, the first ``negatives`` rows of other labels are returned whose score is at
    least ``least`` percent of the positive's and no greater. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or a null or non-finite component take no
    part. Shorter vectors count as filled up with zeros. Rows with equal ids are rows of
    their own, but never each other's positives; equal anchor rows are mined once.
    Components beyond 2^62 / scale count as that value, and scores are cut to the
    longs. Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows = usable_rows(table, is_anchor, label, id_col, vector_col, scale)
    index = materialize(index_rows(rows, fit_references(rows, references)))
    sizes = index.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors")).first()
    slices = max(-(-sizes["rows"] // SLICE_ROWS), work_partitions(spark, max(1, sizes["rows"] // 1024)))
    blocks = max(1, -(-sizes["anchors"] // ANCHOR_BLOCK))
    where = F.xxhash64("id", "label", "vector")
    held = index.select(*_KEYS, F.pmod(where, F.lit(slices)).cast("int").alias("slice"))
    anchors = materialize(
        index.where("is_anchor").select(*_KEYS).dropDuplicates(["id", "label", "vector"])
        .withColumn("block", F.pmod(where, F.lit(blocks)).cast("int"))
        .withColumn("anchor", F.monotonically_increasing_id())
    )

    def same(windows, batch, lower, upper, keys, _asked):
        found = same_label_best(windows, batch, upper, positives)
        return [
            {"anchor": key, "id": i, "score": s}
            for key, (ids, scores) in zip(keys, found, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)
        ]

    def others(windows, batch, lower, upper, keys, asked):
        wanted = [[a["score"] for a in x] for x in asked]
        found = other_label_between(windows, batch, lower, upper, wanted, least, negatives)
        return [
            {"anchor": key, "place": a["place"], "positive": a["id"], "positive_score": a["score"], "id": i, "score": s}
            for key, some, held in zip(keys, asked, found, strict=True) for a, (ids, scores) in zip(some, held, strict=True)
            for i, s in zip(ids.tolist(), scores.tolist(), strict=True)
        ]

    unasked = anchors.withColumn("asked", F.lit(None).cast("array<struct<place:int,id:bigint,score:bigint>>"))
    near = _meet(unasked, held, slices, blocks, same, "anchor long, id long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    asked = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("asked"))
    between = _meet(
        materialize(anchors.join(asked, "anchor")), held, slices, blocks, others,
        "anchor long, place int, positive long, positive_score long, id long, score long",
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    ranked = between.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
