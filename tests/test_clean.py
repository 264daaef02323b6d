from conftest import frame, ledger_row
from ledgersift.operators import clean as c


def test_clean_drops_deleted_and_invalid(ledger):
    kept = {r.id for r in c.clean(ledger).select("id").collect()}
    assert len(kept) == 118
    assert not kept & {"EXP_00018", "EXP_00104"}


def test_first_of_repeated_ids_is_kept(spark):
    rows = [ledger_row(1), ledger_row(1, amount=5.0, updated_at=ledger_row(2)["updated_at"]), ledger_row(3)]
    out = {r.id: r.amount for r in c.clean(frame(spark, rows).repartition(3)).collect()}
    assert out == {"EXP_00001": ledger_row(1)["amount"], "EXP_00003": ledger_row(3)["amount"]}


def test_rank_limit_reaches_below_the_shuffle(ledger):
    plan = c.clean(ledger)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_normalize(spark):
    rows = [
        ledger_row(1, source=" wathsapp", expense_type=" Fuel ", currency=None),
        ledger_row(2, source=None, expense_type=None, currency=" xaf"),
        ledger_row(3, source="Réseaux"),
    ]
    out = {r.id: (r.source, r.expense_type, r.currency) for r in c.normalize(frame(spark, rows)).collect()}
    assert out["EXP_00001"] == ("WHATSAPP", "fuel", "UNKNOWN")
    assert out["EXP_00002"] == ("UNKNOWN", "unknown", "XAF")
    assert out["EXP_00003"][0] == "RESEAUX_SOCIAUX"


def test_attrition(ledger):
    row = c.attrition(ledger).first()
    assert (row.raw_rows, row.soft_deleted, row.duplicate_ids, row.invalid_amount, row.retained) == (
        120, 1, 0, 1, 118,
    )


def test_validation_reasons(spark):
    rows = [ledger_row(1), ledger_row(2, amount=-500.0), ledger_row(3, company_id=None), ledger_row(4, status=None)]
    out = {r.id: r for r in c.validate_input(frame(spark, rows)).collect()}
    assert out["EXP_00001"].rejected is None
    assert out["EXP_00002"].rejected == "amount not positive"
    assert out["EXP_00003"].rejected == "company_id missing"
    assert out["EXP_00004"].status == "pending"


def test_rows_to_ledger_applies_defaults(spark):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id string, company_id string, amount double, currency string, status string")
    row = c.rows_to_ledger(spark, [{"id": "A", "company_id": "C", "amount": 1.0}], schema).first()
    assert (row.currency, row.status) == ("XAF", "pending")


def test_schema_drift(ledger):
    found = {tuple(r) for r in c.schema_drift(ledger.drop("items").withColumnRenamed("state", "stage")).collect()}
    assert found == {("items", "missing"), ("state", "missing"), ("stage", "extra")}
