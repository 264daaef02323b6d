"""The whole audit: batch scoring, trained models and scoring of new rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, MATRIX_COLUMNS, AuditConfig
from ledgersift.operators.clean import arrival_order, clean, normalize, validate_input
from ledgersift.operators.density import DensityModel, fit_density
from ledgersift.operators.ensemble import decide, result
from ledgersift.operators.features import enrich
from ledgersift.operators.iforest import IsolationForestModel, fit_isolation_forest
from ledgersift.operators.knn import Reference, Space
from ledgersift.operators.matrix import (
    align,
    encode,
    impute,
    scale_parameters,
    standardize,
    vectors,
)
from ledgersift.operators.patterns import add_patterns
from ledgersift.operators.rules import apply_rules
from ledgersift.session import Scratch, materialize


def staged_ledger(raw: DataFrame, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """The cleaned, normalised ledger, written once because many passes read it."""
    return write(normalize(clean(raw)))


def featured(base: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """All features and category codes of a staged ledger."""
    return encode(enrich(base, cfg), cfg=cfg, base=base)


@dataclass
class AuditModels:
    """Everything learned from history: scaling, forest, neighbour model."""

    params: dict[str, tuple[float, float]]
    forest: IsolationForestModel
    density: DensityModel
    n_train: int
    threshold: float

    @property
    def info(self) -> dict:
        return {
            "ready": True,
            "n_train": self.n_train,
            "n_features": len(self.params),
            "models": ["IsolationForest", "LOF", "DBSCAN", "Rules", "FraudPatterns"],
            "threshold": self.threshold,
        }

    def info_frame(self, spark: SparkSession) -> DataFrame:
        facts = self.info
        facts["models"] = ", ".join(facts["models"])
        return spark.createDataFrame([facts])

    def matrix(self, feats: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
        """(id, vec) of featured rows, imputed and scaled as in training."""
        scaled = standardize(align(impute(feats, cfg), list(self.params)), self.params)
        return vectors(scaled, list(self.params))

    def detect(self, data: DataFrame, cfg: AuditConfig, relative: bool) -> DataFrame:
        """All detector scores of (id, vec)."""
        return self.forest.transform(data).join(
            self.density.transform(data, cfg, relative), "id"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the models; rows as parquet tables, scalars as one JSON line."""
        self.forest.save(spark, f"{path}/forest")
        d = self.density
        d.ref.rows.write.parquet(f"{path}/reference")
        d.facts.write.parquet(f"{path}/facts")
        state = {
            "params": self.params,
            "n_train": self.n_train,
            "threshold": self.threshold,
            "space": asdict(d.ref.space),
            "sizes": sorted(d.ref.sizes.items()),
            "boxes": d.ref.boxes.tolist(),
            "total": d.ref.total,
            "k": d.k, "low": d.low, "high": d.high, "offset": d.offset,
            "eps": d.eps, "core_k": d.core_k, "limit": d.limit,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(
            f"{path}/state"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> AuditModels:
        s = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
        sizes = {int(k): int(v) for k, v in s["sizes"]}
        ref = Reference(
            spark.read.parquet(f"{path}/reference"),
            Space(**s["space"]),
            sizes,
            np.array(s["boxes"]),
            s["total"],
        )
        density = DensityModel(
            ref, spark.read.parquet(f"{path}/facts"), s["k"], s["low"], s["high"],
            s["offset"], s["eps"], s["core_k"], s["limit"],
        )
        params = {c: (m, d) for c, (m, d) in s["params"].items()}
        forest = IsolationForestModel.load(spark, f"{path}/forest")
        return AuditModels(params, forest, density, s["n_train"], s["threshold"])


def fit_models(feats: DataFrame, cfg: AuditConfig = DEFAULT) -> tuple[AuditModels, DataFrame]:
    """Fit all detectors on featured rows; also returns the training rows' scores by id."""
    matrix = impute(feats, cfg)
    columns = [c for c in MATRIX_COLUMNS if c in matrix.columns]
    params = scale_parameters(matrix, columns)
    with Scratch(feats.sparkSession) as scratch:
        data = scratch(vectors(standardize(matrix, params), columns))
        forest, by_forest = fit_isolation_forest(data, cfg)
        density, by_density = fit_density(data, cfg)
    models = AuditModels(params, forest, density, density.ref.total, cfg.final_limit)
    return models, by_forest.join(by_density, "id")


def assess(
    feats: DataFrame, base: DataFrame, detected: DataFrame, cfg: AuditConfig, policy: str
) -> DataFrame:
    """Rules, patterns, blend and decision for featured rows with detector scores by id."""
    ruled = apply_rules(feats, cfg)
    judged = add_patterns(ruled, cfg, base).withColumn("score_fraud", F.col("fraud_score_combined"))
    return decide(judged.join(detected, "id"), cfg, policy)


def audit(raw: DataFrame, cfg: AuditConfig = DEFAULT, with_features: bool = False) -> DataFrame:
    """Score a raw ledger end to end."""
    base = staged_ledger(raw)
    feats = materialize(featured(base, cfg))
    _, detected = fit_models(feats, cfg)
    return result(assess(feats, base, detected, cfg, "batch"), with_features)


def fit(raw: DataFrame, cfg: AuditConfig = DEFAULT) -> AuditModels:
    """Train on a raw ledger."""
    with Scratch(raw.sparkSession) as scratch:
        feats = scratch(featured(staged_ledger(raw, scratch), cfg))
        return fit_models(feats, cfg)[0]


def with_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History and new rows in one frame tagged ``is_new``; a new row replaces its id."""
    kept = history.join(new.select("id").distinct(), "id", "left_anti")
    return kept.withColumn("is_new", F.lit(0)).unionByName(
        new.withColumn("is_new", F.lit(1)), allowMissingColumns=True
    )


def split_new(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable rows, rejected rows with the reason)."""
    checked = validate_input(new)
    return (
        checked.where(F.col("rejected").isNull()).drop("rejected"),
        checked.where(F.col("rejected").isNotNull()),
    )


def split_scorable(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score, refused rows with the reason): together every arrival, once each.

    Besides what :func:`split_new` rejects, cleaning would lose deleted rows and all
    but the first to arrive of the rows with one id; they are refused here.
    """
    accepted, rejected = split_new(new)
    refused = [rejected]
    if "deleted_at" in accepted.columns:
        refused.append(accepted.where(F.col("deleted_at").isNotNull()).withColumn("rejected", F.lit("deleted")))
        accepted = accepted.where(F.col("deleted_at").isNull())
    times = [c for c in ("updated_at", "created_at") if c in accepted.columns]
    first = Window.partitionBy("id").orderBy(*arrival_order(accepted, times))
    ranked = accepted.withColumn("_place", F.row_number().over(first))
    refused.append(ranked.where("_place > 1").drop("_place").withColumn("rejected", F.lit("id repeated")))
    return ranked.where("_place = 1").drop("_place"), reduce(DataFrame.unionByName, refused)


def score_new(
    history: DataFrame,
    new: DataFrame,
    models: AuditModels,
    cfg: AuditConfig = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Score new raw rows against raw history: (results, rejected rows).

    Features are taken over history and new rows together; the detectors only
    know history. Flags follow the online decision.
    """
    accepted, rejected = split_scorable(new)
    tagged = with_history(history, accepted)
    base = staged_ledger(tagged)
    feats = materialize(featured(base, cfg))
    mine = feats.where(F.col("is_new") == 1)
    # Imputation is over all rows, the detectors look at the new ones.
    matrix = models.matrix(feats, cfg).join(mine.select("id"), "id", "left_semi")
    with Scratch(feats.sparkSession) as scratch:
        detected = materialize(models.detect(scratch(matrix), cfg, relative=False))
    ruled = apply_rules(feats, cfg)
    judged = add_patterns(ruled, cfg, base).where(F.col("is_new") == 1)
    scored = judged.withColumn("score_fraud", F.col("fraud_score_combined")).join(detected, "id")
    return result(decide(scored, cfg, "online")), rejected
