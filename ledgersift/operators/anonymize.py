"""Pseudonyms, billing sanitising and date shift for sharing a ledger."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, TIMESTAMP_COLUMNS, AuditConfig
from ledgersift.operators.skew import attach, largest_group, number_rows
from ledgersift.session import materialize

ORDER = ["updated_at", "id"]
# Prefixes, the neutral metadata document and the shape of internal method ids.
PREFIXES = {"company_id": "COMP", "user_id": "USR", "shop_id": "SHOP", "supplier_id": "SUPP"}
METADATA = '{"note": null, "matchingMediaIds": []}'
METHOD_ID = "^01[0-9a-z]{24}$"
SHIFT_DAYS = 70


def pseudonyms(
    df: DataFrame, column: str, prefix: str, order: list[str] = ORDER, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """(value, alias): PREFIX_0001, ... in order of first appearance; nulls and blanks excluded."""
    seen = (
        df.where(F.trim(F.col(column)) != "")
        .groupBy(column)
        .agg(F.min(F.struct(*order)).alias("_seen"))
        .select(column, *[F.col(f"_seen.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    )
    seen = materialize(seen)
    places = [f"_o{i}" for i in range(len(order))]
    numbered = number_rows(seen, [*places, column], "_no", seen.count(), cfg.limits)
    alias = F.format_string(f"{prefix}_%04d", F.col("_no"))
    return numbered.select(column, alias.alias(f"{column}_alias"))


def replace_by_alias(
    df: DataFrame, column: str, aliases: DataFrame, keep_unknown: bool, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    largest = largest_group(df, [column])
    joined = attach(df, aliases, [column], largest, cfg.limits)
    alias = F.col(f"{column}_alias")
    return joined.withColumn(column, F.coalesce(alias, column) if keep_unknown else alias).drop(
        f"{column}_alias"
    )


def alias_dictionary(
    df: DataFrame, known: DataFrame | None = None, order: list[str] = ORDER, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """(kind, value, number) of the four entity columns: the dictionary that keeps aliases the same.

    All rows of ``known`` stay as they are; values it lacks are appended per kind in their
    order of first appearance, after its largest number. Nulls and blanks get no number.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in PREFIXES])
    places = [f"_o{i}" for i in range(len(order))]
    cells = df.select(F.inline(entries), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)])
    seen = (
        cells.where(F.trim("value") != "")
        .groupBy("kind", "value")
        .agg(F.min(F.struct(*places)).alias("_seen"))
        .select("kind", "value", "_seen.*")
    )
    if known is not None:
        seen = seen.join(known.select("kind", "value"), ["kind", "value"], "left_anti")
    seen = materialize(seen)
    # One numbering for all kinds; a kind starts where the ones before it end.
    numbered = number_rows(seen, ["kind", *places, "value"], "_no", seen.count(), cfg.limits)
    starts = materialize(numbered.select("kind", "value", "_no"))
    first = {r["kind"]: r["low"] for r in starts.groupBy("kind").agg(F.min("_no").alias("low")).collect()}
    last = {}
    if known is not None:
        last = {r["kind"]: r["high"] for r in known.groupBy("kind").agg(F.max("number").alias("high")).collect()}
    shift = F.lit(0).cast("long")
    for kind, low in first.items():
        shift = F.when(F.col("kind") == kind, F.lit(last.get(kind, 0) - low + 1)).otherwise(shift)
    added = starts.select("kind", "value", (F.col("_no") + shift).cast("long").alias("number"))
    return added if known is None else known.select("kind", "value", "number").unionByName(added)


def pseudonymize(
    df: DataFrame,
    order: list[str] = ORDER,
    cfg: AuditConfig = DEFAULT,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Replace the four entity columns by pseudonyms and renumber ids and references.

    ``dictionary`` is the :func:`alias_dictionary` to use, for instance that of an earlier
    export extended by this one's values; without it the export has one of its own.
    """
    known = alias_dictionary(df, order=order, cfg=cfg) if dictionary is None else dictionary
    out = df
    for column, prefix in PREFIXES.items():
        alias = F.format_string(f"{prefix}_%04d", F.col("number")).alias(f"{column}_alias")
        aliases = known.where(F.col("kind") == column).select(F.col("value").alias(column), alias)
        out = replace_by_alias(out, column, aliases, column == "company_id", cfg)
    out = number_rows(out, order, "_no", df.count(), cfg.limits)
    return out.withColumns(
        {
            "id": F.format_string("EXP_%05d", "_no"),
            "reference": F.when(
                F.col("reference").isNotNull(), F.format_string("#REF_%05d", "_no")
            ),
        }
    ).drop("_no")


def _parsed(column: str) -> Column:
    """A billing object as a map of its keys, in their order, to values of any type; null for anything else."""
    plain = F.replace(F.replace(F.col(column), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    valid = F.get_json_object(plain, "$").startswith("{")
    return F.when(valid, F.from_json(plain, "map<string,variant>"))


def _text(document: str, key: str) -> Column:
    """A field as text; null when absent, null or empty."""
    value = F.try_variant_get(F.try_element_at(F.col(document), F.lit(key)), "$", "string")
    return F.when(value != "", value)


def _quoted(text: Column) -> Column:
    return F.parse_json(F.concat(F.lit('"'), text, F.lit('"')))


def sanitize_billing(
    df: DataFrame,
    named_methods: tuple[str, ...],
    order: list[str] = ORDER,
    replacement: str = "Corporate account",
    cfg: AuditConfig = DEFAULT,
) -> DataFrame:
    """Billing documents with pseudonymous accounts and methods and without address.

    ``named_methods`` lists words that identify a person or firm inside a payment
    method; there is no default, since only the owner of the data knows them. All
    other keys stay as they are. What is not a JSON object becomes null.
    """
    # The documents are parsed and written once; the steps below read them.
    parsed = materialize(df.withColumn("_b", F.to_json(_parsed("billing"))))
    parsed = parsed.withColumn("_b", F.from_json("_b", "map<string,variant>")).withColumns(
        {"_account": _text("_b", "treasury_account_id"), "_plain": _text("_b", "method")}
    ).withColumn("_method", F.when(F.lower("_plain").rlike(METHOD_ID), F.col("_plain")))
    out = replace_by_alias(
        parsed, "_account", pseudonyms(parsed, "_account", "ACC", order, cfg), True, cfg
    )
    out = replace_by_alias(
        out, "_method", pseudonyms(parsed, "_method", "METH", order, cfg), False, cfg
    )
    named = F.lit(False)
    for word in named_methods:
        named = named | F.lower("_plain").contains(word.lower())
    method = F.when(named, F.parse_json(F.lit(json.dumps(replacement)))).when(
        F.col("_method").isNotNull(), _quoted(F.col("_method"))
    )
    edited = F.transform_values(
        F.map_filter("_b", lambda key, _: key != "address_id"),
        lambda key, value: F.when(
            (key == "treasury_account_id") & F.col("_account").isNotNull(), _quoted(F.col("_account"))
        ).when((key == "method") & method.isNotNull(), method).otherwise(value),
    )
    document = F.to_json(F.map_concat(edited, F.create_map(F.lit("address_id"), F.parse_json(F.lit("null")))))
    return out.withColumn("billing", F.when(F.col("_b").isNotNull(), document)).drop(
        "_b", "_account", "_method", "_plain"
    )


def shift_dates(df: DataFrame, days: int = SHIFT_DAYS) -> DataFrame:
    """Move all timestamps; a multiple of seven keeps weekdays, hours and distances."""
    step = F.make_dt_interval(days=F.lit(days))
    return df.withColumns({c: F.col(c) + step for c in TIMESTAMP_COLUMNS if c in df.columns})


def blank_documents(df: DataFrame) -> DataFrame:
    """Neutral metadata, no items, no shipping."""
    none = F.lit(None).cast("string")
    return df.withColumns({"metadata": F.lit(METADATA), "items": none, "shipping": none})


def anonymize(
    df: DataFrame,
    order: list[str] = ORDER,
    days: int = SHIFT_DAYS,
    named_methods: tuple[str, ...] = (),
    cfg: AuditConfig = DEFAULT,
) -> DataFrame:
    """The full job: billing, pseudonyms, documents and dates. ``named_methods`` as in :func:`sanitize_billing`."""
    safe = materialize(sanitize_billing(df, named_methods, order, cfg=cfg))
    return shift_dates(blank_documents(pseudonymize(safe, order, cfg)), days)
