"""Features of arriving rows from saved state: only the touched users' rows are read again."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgersift.config import CATEGORICAL_COLUMNS, DEFAULT, AuditConfig
from ledgersift.operators.clean import clean, normalize
from ledgersift.operators.features import enrich
from ledgersift.operators.matrix import encode
from ledgersift.operators.order_counts import block_totals, counted_quantiles, value_counts
from ledgersift.plans.audit import split_scorable, staged_ledger
from ledgersift.session import materialize

_KNOWN = ["id", "user_id", "supplier_id", "amount", *CATEGORICAL_COLUMNS]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _moments(df: DataFrame) -> tuple[int, float, float]:
    n, mean, var = df.agg(F.count("amount"), F.avg("amount"), F.var_pop("amount")).first()
    return n, mean or 0.0, (var or 0.0) * n


def _with(a: tuple, b: tuple) -> tuple:
    """(count, mean, squared deviations) of two sets together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _without(a: tuple, b: tuple) -> tuple:
    """The reverse of :func:`_with`: set ``b`` leaves ``a``."""
    n = a[0] - b[0]
    if not n:
        return 0, 0.0, 0.0
    mean = (a[0] * a[1] - b[0] * b[1]) / n
    gap = b[1] - mean
    return n, mean, max(a[2] - b[2] - gap * gap * n * b[0] / a[0], 0.0)


@dataclass
class Change:
    """Accepted arrivals (cleaned) and the known rows that they replace, with all refused arrivals."""

    fresh: DataFrame
    replaced: DataFrame
    refused: DataFrame


@dataclass
class LedgerState:
    """Saved figures of a ledger that arrivals are merged into.

    Tables under ``path``, each written as one folder per version: ``rows`` by bucket of the
    user, ``ids`` by bucket of the id, ``suppliers`` by bucket of the supplier, ``amounts``
    by value block, ``blocks`` and ``categories`` (small), and ``versions`` with the moments
    of all amounts. A version counts once its row in ``versions`` is there, so a failed write
    is repeated, not seen. Removals are kept as negative counts and marked rows.
    """

    spark: SparkSession
    path: str
    buckets: int = 256
    cfg: AuditConfig = DEFAULT
    _schemas: dict[str, StructType] = field(default_factory=dict)

    @staticmethod
    def build(raw: DataFrame, path: str, buckets: int = 256, cfg: AuditConfig = DEFAULT) -> LedgerState:
        """The state of a raw ledger."""
        state = LedgerState(raw.sparkSession, path, buckets, cfg)
        base = staged_ledger(raw)
        state._write(0, base, base.limit(0).select(*_KNOWN), _moments(base))
        return state

    def change(self, new: DataFrame) -> Change:
        """Arrivals against what is known; an accepted row replaces the known row of its id."""
        accepted, refused = split_scorable(new)
        fresh = materialize(normalize(clean(accepted)))
        ids = fresh.select("id", _bucket("id", self.buckets).alias("part"))
        replaced = self._latest("ids", "part", self._listed(ids, "part"), fresh.select("id"), ["id"])
        return Change(fresh, materialize(replaced.select(*_KNOWN)), refused)

    def features(self, change: Change) -> DataFrame:
        """All features and category codes of the accepted arrivals.

        Equal to those of the whole ledger with the arrivals in it. Read are the rows of the
        arrivals' users, the figures of their suppliers, and the value blocks of the quartiles.
        """
        base = materialize(
            self.touched_rows(change).withColumn("is_new", F.lit(0)).unionByName(
                change.fresh.withColumn("is_new", F.lit(1)), allowMissingColumns=True
            )
        )
        feats = enrich(base, self.cfg, self.overall(change), self.suppliers(change))
        return encode(feats, cfg=self.cfg, base=self.categories(change)).where("is_new = 1").drop("is_new")

    def apply(self, change: Change) -> None:
        """Merge a change into the saved state as its next version."""
        self._write(self.version + 1, change.fresh, change.replaced, self._moments_after(change))

    # ------------------------------------------------------------ figures with a change in them

    def touched_rows(self, change: Change) -> DataFrame:
        """The known rows of the users that arrivals belong to, without those replaced."""
        users = change.fresh.select("user_id").where(F.col("user_id").isNotNull()).distinct()
        buckets = self._listed(users.select(_bucket("user_id", self.buckets).alias("bucket")), "bucket")
        rows = self._latest("rows", "bucket", buckets, users, ["user_id"])
        return rows.join(change.fresh.select("id"), "id", "left_anti")

    def overall(self, change: Change) -> dict[str, float | None]:
        n, mean, m2 = self._moments_after(change)
        extra = materialize(self._amounts(change.fresh, change.replaced))
        counts = self._read("amounts").select("block", "value", "n").unionByName(extra)
        totals = self._read("blocks").select("block", "n").unionByName(block_totals(extra))
        q1, q3 = counted_quantiles(counts, totals, [0.25, 0.75], self.cfg.limits)
        return {"mean": mean, "std": math.sqrt(m2 / (n - 1)) if n > 1 else None, "q1": q1, "q3": q3}

    def suppliers(self, change: Change) -> DataFrame:
        """Uses and mean amount; complete for the suppliers of the rows that are scored."""
        extra = self._supplier_sums(change.fresh, change.replaced)
        wanted = change.fresh.select("supplier_id").where(F.col("supplier_id").isNotNull()).distinct()
        parts = self._listed(wanted.select(_bucket("supplier_id", self.buckets).alias("part")), "part")
        saved = self._read("suppliers").where(F.col("part").isin(parts)).join(wanted, "supplier_id", "left_semi")
        both = saved.select("supplier_id", "n", "total").unionByName(extra.select("supplier_id", "n", "total"))
        sums = both.groupBy("supplier_id").agg(F.sum("n").alias("_uses"), F.sum("total").alias("total"))
        return materialize(
            sums.where("_uses > 0").select("supplier_id", "_uses", (F.col("total") / F.col("_uses")).alias("_mean"))
        )

    def categories(self, change: Change) -> DataFrame:
        """One row per category in use, in a column of its name, as :func:`encode` reads them."""
        both = self._read("categories").select("name", "value", "n").unionByName(
            self._category_counts(change.fresh, change.replaced)
        )
        used = both.groupBy("name", "value").agg(F.sum("n").alias("n")).where("n > 0")
        return materialize(
            used.select(*[F.when(F.col("name") == c, F.col("value")).alias(c) for c in CATEGORICAL_COLUMNS])
        )

    # ------------------------------------------------------------ tables

    @property
    def _last(self) -> tuple:
        return self.spark.read.parquet(f"{self.path}/versions").orderBy(F.desc("v")).first()

    @property
    def version(self) -> int:
        return self._last["v"]

    def _moments_after(self, change: Change) -> tuple:
        last = self._last
        grown = _with((last["n"], last["mean"], last["m2"]), _moments(change.fresh))
        return _without(grown, _moments(change.replaced))

    def _read(self, table: str) -> DataFrame:
        if not self._schemas:
            rows = self.spark.read.parquet(f"{self.path}/schemas").collect()
            self._schemas.update({r["name"]: StructType.fromJson(json.loads(r["schema"])) for r in rows})
        saved = self.spark.read.schema(self._schemas[table]).parquet(f"{self.path}/{table}")
        return saved.where(F.col("version") <= self.version)

    @staticmethod
    def _listed(df: DataFrame, column: str) -> list[int]:
        """The buckets in use, never more than there are buckets."""
        return [r[0] for r in df.select(column).distinct().collect()]

    def _latest(self, table: str, part: str, parts: list[int], keys: DataFrame, on: list[str]) -> DataFrame:
        """Rows of the given keys as of now: the newest version of each id, unless it has gone."""
        rows = self._read(table).where(F.col(part).isin(parts)).join(keys, on, "left_semi").drop(part)
        names = [c for c in rows.columns if c not in ("version", "gone")]
        newest = rows.groupBy("id").agg(
            F.max_by(F.struct(*names, "gone"), F.struct("version", ~F.col("gone"))).alias("r")
        )
        return newest.where("NOT r.gone").select(*[F.col(f"r.{c}") for c in names])

    def _amounts(self, fresh: DataFrame, gone: DataFrame) -> DataFrame:
        return value_counts(fresh, "amount").unionByName(value_counts(gone, "amount", -1))

    def _supplier_sums(self, fresh: DataFrame, gone: DataFrame) -> DataFrame:
        signed = fresh.select("supplier_id", "amount", F.lit(1).alias("s")).unionByName(
            gone.select("supplier_id", "amount", F.lit(-1).alias("s"))
        )
        sums = signed.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(
            F.sum("s").alias("n"), F.sum(F.col("amount") * F.col("s")).alias("total")
        )
        return sums.withColumn("part", _bucket("supplier_id", self.buckets))

    def _category_counts(self, fresh: DataFrame, gone: DataFrame) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in CATEGORICAL_COLUMNS])
        signed = fresh.select(F.inline(entries), F.lit(1).alias("s")).unionByName(
            gone.select(F.inline(entries), F.lit(-1).alias("s"))
        )
        return signed.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.sum("s").alias("n"))

    def _write(self, version: int, fresh: DataFrame, gone: DataFrame, moments: tuple) -> None:
        home = F.when(F.col("user_id").isNull(), _bucket("id", self.buckets)).otherwise(_bucket("user_id", self.buckets))
        marked = fresh.withColumn("gone", F.lit(False)).unionByName(
            gone.withColumn("gone", F.lit(True)), allowMissingColumns=True
        )
        counts = materialize(self._amounts(fresh, gone))
        tables = {
            "rows": (marked.withColumn("bucket", home), "bucket"),
            "ids": (marked.select(*_KNOWN, "gone", _bucket("id", self.buckets).alias("part")), "part"),
            "suppliers": (self._supplier_sums(fresh, gone), "part"),
            "amounts": (counts, "block"),
            "blocks": (block_totals(counts), None),
            "categories": (self._category_counts(fresh, gone), None),
        }
        shapes = []
        for name, (table, part) in tables.items():
            if part:
                # A few writers per bucket, so that one user's rows are not all in one task.
                table = table.repartition(F.col(part), F.pmod(F.xxhash64(table.columns[0]), F.lit(4)))
                writer = table.write.partitionBy(part)
            else:
                writer = table.coalesce(1).write
            writer.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")
            shapes.append((name, table.withColumn("version", F.lit(0)).schema.json()))
        if version == 0:
            shaped = self.spark.createDataFrame(shapes, "name string, schema string")
            shaped.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas")
        row = self.spark.createDataFrame([(version, *moments)], "v long, n long, mean double, m2 double")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
