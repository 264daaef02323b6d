"""Near-duplicate embeddings by E8 lattice hashing.

A table projects unit vectors to eight dimensions by random directions, two
times over, and decodes both halves to points of the E8 lattice; the pair of
points is the cell. Every vector goes to its own cell and to the neighbouring
cells next in distance, in several tables. Vectors that share a cell are
compared by cosine in double precision; a pair counts in the first cell that it
shares, so nothing has to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.components import connected_components
from ledgersift.session import materialize

TABLES, PROBES, SCALE, SEED = 8, 4, 0.6, 8
LIMIT = 0.95
BLOCK = 1500


def _coset(x: np.ndarray, shift: float) -> list[np.ndarray]:
    """The nearest points of D8 + shift, best first (three of them)."""
    y = x - shift
    near = np.rint(y)
    off = y - near
    odd = (near.sum(axis=1).astype(np.int64) & 1).astype(bool)
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))

    def moved(*ranks: int) -> np.ndarray:
        out = near.copy()
        for r in ranks:
            at = order[:, r]
            out[rows, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
        return out + shift

    plain = near + shift
    pick = lambda a, b: np.where(odd[:, None], a, b)
    return [pick(moved(0), plain), pick(moved(1), moved(0, 1)), pick(moved(2), moved(0, 2))]


def e8_points(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) of lattice points near each row of ``x``: the nearest and some next ones."""
    found = np.stack(_coset(x, 0.0) + _coset(x, 0.5), axis=1)
    far = ((found - x[:, None, :]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")[:, :count]
    rows = np.arange(len(x))[:, None]
    return found[rows, order], far[rows, order]


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """The cells of unit vectors, own cell first per table: (rows, tables * (1 + probes)) 64-bit numbers."""
    rng = np.random.default_rng(SEED)
    n, width = unit.shape
    weights = rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        x = unit @ rng.standard_normal((width, 16)) * scale + rng.uniform(-1, 1, 16)
        some = min(6, 1 + probes)
        (p, d), (q, e) = e8_points(x[:, :8], some), e8_points(x[:, 8:], some)
        # Twice a lattice point has whole coordinates; odd multipliers and a shift make one number of them.
        a = ((2 * p).astype(np.int64).astype(np.uint64) * weights[:8]).sum(axis=2)
        b = ((2 * q).astype(np.int64).astype(np.uint64) * weights[8:]).sum(axis=2)
        both = (d[:, :, None] + e[:, None, :]).reshape(n, -1)
        order = np.argsort(both, axis=1, kind="stable")[:, :1 + probes]
        code = (a[:, :, None] + b[:, None, :] * np.uint64(0x9E3779B97F4A7C15)).reshape(n, -1)[np.arange(n)[:, None], order]
        code = (code ^ (code >> np.uint64(31)) ^ np.uint64(t)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, t] = code ^ (code >> np.uint64(29))
    return out.reshape(n, -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: rep (smallest vec_id), copies, embedding (float32 as given).

    Null vectors, empty ones, zero ones and those with null or non-finite components are left out.
    """
    part = F.col("embedding")
    usable = part.isNotNull() & (F.size(part) > 0) & F.forall(
        part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ) & F.exists(part, lambda x: x != 0)
    # Equal vectors meet by partial aggregation, so a hot one is one row per task.
    return vectors.where(F.coalesce(usable, F.lit(False))).groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )


def group_links(reps: np.ndarray, copies: np.ndarray, codes: np.ndarray, unit: np.ndarray, cell: int,
                left: np.ndarray, right: np.ndarray, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(links per row, label per row) of the pairs left x right that count in this cell.

    A pair counts where the cell is the first one that both vectors have. Labels
    name the components inside the group by row number.
    """
    n = len(reps)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, len(left), 512):
        rows = left[at:at + 512]
        near = unit[rows] @ unit[right].T >= limit
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        ordered = reps[i] < reps[j]
        i, j = i[ordered], j[ordered]
        for k in range(0, len(i), 1 << 15):
            a, b = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
            first = np.full(len(a), -1, np.int64)
            for c in range(codes.shape[1]):
                open_ = first < 0
                if not open_.any():
                    break
                hit = (codes[a[open_], c][:, None] == codes[b[open_]]).any(axis=1)
                where = np.flatnonzero(open_)[hit]
                first[where] = codes[a[where], c]
            mine = first == cell
            np.add.at(links, a[mine], copies[b[mine]])
            np.add.at(links, b[mine], copies[a[mine]])
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
    return links, label


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their cosine is at least ``limit``. Equal vectors form one
    class before anything else; a class's copies link with each other and count
    in the links of its partners. Unusable vectors (see :func:`vector_classes`)
    link with nothing and are components of their own, as are vectors of other
    lengths to each other. Repeated vec_ids are reported as often as they come.
    An empty table gives no rows. Cells with more than ``block`` members are cut
    into blocks, and each pair of blocks is a task's group: no cell is capped.
    """
    base = vectors.select("vec_id", "embedding")
    classes = vector_classes(base)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            for width in np.unique(lengths):
                part = table.take(np.flatnonzero(lengths == width)).combine_chunks()
                unit = _unit(_matrix(part.column("embedding")))
                code = cells(unit).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).combine_chunks() for c in ("rep", "copies", "embedding")),
                     pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), code.shape[1]).cast(pa.list_(pa.int64()))],
                    ["rep", "copies", "embedding", "codes"],
                )

    coded_classes = materialize(
        classes.select("rep", "copies", "embedding").mapInArrow(
            coded, "rep long, copies long, embedding array<float>, codes array<long>"
        )
    )
    members = coded_classes.select("rep", F.size("embedding").alias("width"), F.explode(F.array_distinct("codes")).alias("cell"))
    crowded = members.groupBy("cell", "width").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = members.join(crowded, ["cell", "width"]).select(
        "rep", "cell", blocks.alias("blocks"),
        F.pmod(F.xxhash64("rep", F.lit(SEED)), blocks).cast("int").alias("own"),
    )
    # A member of block b takes part in the pairs (i, b) and (b, j).
    placed = met.select(
        "rep", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "rep", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    groups = placed.join(coded_classes, "rep")

    def compare(table: pa.Table) -> pa.Table:
        reps, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        i, j, cell = (table.column(c)[0].as_py() for c in ("i", "j", "cell"))
        codes = _matrix(table.column("codes"))
        unit = _unit(_matrix(table.column("embedding")))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if i != j:
            links, label = group_links(reps, copies, codes, unit, cell, left, right, limit)
            more, label2 = group_links(reps, copies, codes, unit, cell, right, left, limit)
            links = links + more
            pairs = np.concatenate([np.stack([np.arange(len(reps)), label]), np.stack([np.arange(len(reps)), label2])], axis=1)
        else:
            links, label = group_links(reps, copies, codes, unit, cell, left, right, limit)
            pairs = np.stack([np.arange(len(reps)), label])
        linked = pairs[0] != pairs[1]
        return pa.table({
            "rep": pa.array(np.concatenate([reps, reps[pairs[0][linked]]]), pa.int64()),
            "links": pa.array(np.concatenate([links, np.zeros(linked.sum(), np.int64)]), pa.int64()),
            "partner": pa.array(np.concatenate([reps, reps[pairs[1][linked]]]), pa.int64()),
        })

    found = materialize(
        groups.groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, partner long")
        .where("links > 0 or rep <> partner")
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("rep <> partner").select(F.col("rep").alias("a"), F.col("partner").alias("b")))
    per_class = (
        coded_classes.select("rep", "copies", "embedding")
        .join(counts, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return base.join(per_class, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
