import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgersift.config import AuditConfig, ScaleLimits  # noqa: E402
from ledgersift.session import local_session  # noqa: E402

LEDGER = (
    "id string, company_id string, user_id string, shop_id string, supplier_id string, "
    "reference string, status string, currency string, amount double, source string, "
    "due_date timestamp_ntz, paid_at timestamp_ntz, items string, shipping string, "
    "billing string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "deleted_at timestamp_ntz, expense_type string, credit_code string, debit_code string, "
    "state bigint"
)
TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sliced():
    """Limits so low that every operator takes its plan for oversized keys."""
    return AuditConfig(limits=ScaleLimits(group_rows=4, frame_rows=2, slices=7, salt=5))


KINDS = ("fuel", "rent", "food", "travel", "other", "repair", "training")
CHANNELS = ("POS", "EMAIL", "WHATSAPP", "DASHBOARD")
LARGE, ROUND, GONE, NEGATIVE = 37, 71, 18, 104  # planted rows of ``ledger_rows``


def ledger_row(i, **changes):
    """Row ``i``: amounts grow and fall on a geometric scale, times are uneven, every sixth row has no supplier."""
    at = dt.datetime(2025, 11, 3, 8, 20) + dt.timedelta(hours=5 * i, minutes=i * i % 41)
    row = {
        "id": f"EXP_{i:05d}", "company_id": f"COMP_{i % 2}", "user_id": f"AGENT_{i % 7}",
        "shop_id": f"SHOP_{i % 3}", "supplier_id": None if i % 6 == 5 else f"VENDOR_{i * 5 % 13}",
        "reference": f"R{i}", "status": "APPROVED", "currency": "XAF",
        "amount": round(4000 * 1.07 ** (i * 37 % 53) + i, 2), "source": CHANNELS[i % 4],
        "due_date": at + dt.timedelta(days=9), "paid_at": None, "items": "[]", "shipping": None,
        "billing": '{"treasury_account_id": "T1", "method": "cash"}', "metadata": "{}",
        "created_at": at, "updated_at": at, "deleted_at": None,
        "expense_type": KINDS[i % 7], "credit_code": "C", "debit_code": "D", "state": 1,
    }
    return {**row, **changes}


@pytest.fixture(scope="session")
def ledger_rows():
    """Rows with one very large, one round, one deleted and one negative amount."""
    rows = [ledger_row(i) for i in range(120)]
    rows[LARGE]["amount"] = 9_250_000.0
    rows[ROUND]["amount"] = 300_000.0
    rows[GONE]["deleted_at"] = dt.datetime(2026, 1, 7)
    rows[NEGATIVE]["amount"] = -42.5
    return rows


@pytest.fixture(scope="session")
def ledger(spark, ledger_rows):
    return frame(spark, ledger_rows)


def frame(spark, rows, schema=LEDGER):
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([[r.get(n) for n in names] for r in rows], schema)


def by_id(df):
    return {r["id"]: r for r in df.collect()}
