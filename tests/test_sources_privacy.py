import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import frame, ledger_row
from ledgersift.operators import anonymize as privacy
from ledgersift.sources import dump
from ledgersift.sources.dump import read_dump, scan_line, split_rows, write_dump
from ledgersift.sources.files import read_csv_ledger, write_report

COLUMNS = (
    "`id`, `company_id`, `user_id`, `amount`, `billing`, `created_at`, `deleted_at`, `state`"
)


@pytest.mark.parametrize("text, cells", [
    ("1, 'test', NULL, 42.5", ["1", "'test'", "NULL", "42.5"]),
    ("'{\"a\": 1, \"b\": [2, 3]}', 'x'", ["'{\"a\": 1, \"b\": [2, 3]}'", "'x'"]),
    (r"'O\'Reilly', 2", [r"'O\'Reilly'", "2"]),
    ("'a (b), c', ''", ["'a (b), c'", "''"]),
])
def test_cells(text, cells):
    assert split_rows(f"({text}), ({text})") == ([cells, cells], [])


@pytest.mark.parametrize("body, rows, strays", [
    (r"('a',1,'p;\nq'),('b',2,NULL)", [["'a'", "1", r"'p;\nq'"], ["'b'", "2", "NULL"]], []),
    ("""(1, {"k": {"z": 1, "s": "it's)"}}, x)""", [["1", """{"k": {"z": 1, "s": "it's)"}}""", "x"]], []),
    (r"('it''s', '', '\\'), odd, ()", [["'it''s'", "''", r"'\\'"], [""]], ["odd"]),
    ("('a', (1, (2))), ('open", [["'a'", "(1, (2))"]], ["('open"]),
    ("", [], []),
])
def test_tuples(body, rows, strays):
    assert split_rows(body) == (rows, strays)


def test_lines_pass_their_state_on():
    assert scan_line("a; 'b;", 0) == (1, [1]) and scan_line("c'; d\\", 1) == (0, [2])
    assert scan_line("-- it's; no", 0) == (0, []) and scan_line("-- it's; no", 1) == (0, [7])
    assert scan_line("x\\", 1) == (1, []) and scan_line("'\\'';\"", 0) == (2, [4])


HARD = [
    "p;\nq", "; INSERT INTO expenses (x) VALUES (1);\n", "it's", "''", "\\", "\\'", "\\n", "a\r\nb", '{"k": {"z": 1}}', "-- no comment", "# none",
    "('", "');", '"', "", " lead", "tail \t", "\n", "NULL", "é日🎉", "/* x", "`", ",", "x" * 5000 + ";\n",
]


def test_hard_texts_in_blocks_of_any_size(spark, tmp_path):
    rows = [ledger_row(i, metadata=t, billing=t[::-1]) for i, t in enumerate(HARD)] + [ledger_row(99, metadata=None)]
    write_dump(frame(spark, rows).repartition(3), str(tmp_path / "d"), batch=5)
    # A dump by another hand: breaks inside strings, doubled quotes, several statements on a line.
    shown = [t.replace("\\", "\\\\").replace("'", "''") for t in HARD]
    other = "-- it's a comment\nSET NAMES 'utf8'; " + "".join(
        f"INSERT INTO expenses (id, metadata) VALUES ('{i}', '{t}'),\n ('x', 'too', 'many');\n# it's\n" if i % 2
        else f"insert into `expenses` (`id`,`metadata`) values ('{i}','{t}');"
        for i, t in enumerate(shown)
    )
    (tmp_path / "o.sql").write_text(other, newline="")
    width = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (width, "97", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back, rejected = read_dump(spark, str(tmp_path / "d"))
            assert rejected.count() == 0
            got = {r.id: (r.metadata, r.billing) for r in back.collect()}
            assert got == {r["id"]: (r["metadata"], r["billing"]) for r in rows}
            back, rejected = read_dump(spark, str(tmp_path / "o.sql"))
            assert {r.id: r.metadata for r in back.collect()} == {str(i): t for i, t in enumerate(HARD)}
            assert [r.found for r in rejected.collect()] == [3] * (len(HARD) // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)


def test_csv_keeps_every_text(spark, tmp_path):
    rows = [ledger_row(i, metadata=t) for i, t in enumerate(HARD)]
    write_report(frame(spark, rows), str(tmp_path / "h.csv"))
    back = {r.id: r.metadata for r in read_csv_ledger(spark, str(tmp_path / "h.csv")).collect()}
    assert back == {r["id"]: r["metadata"] for r in rows}


def test_dump_with_quotes_json_and_bad_rows(spark, tmp_path):
    path = tmp_path / "ledger.sql"
    path.write_text(
        "-- a comment\n\n"
        f"INSERT INTO `expenses` ({COLUMNS}) VALUES\n"
        "  ('E1', 'C1', NULL, 150000.00, '{\"a\": \"x, y\", \"b\": 1}', '2026-05-01 09:00:00', NULL, 1),\n"
        "  ('E2', 'C\\'est; bien', 'U2', -5, null, 'not a date', '2026-05-02 00:00:00', x),\n"
        "  ('E3', 'too few');\n"
        f"INSERT INTO expenses ({COLUMNS}) VALUES ('E4', 'a\\\\b', 'U', abc, '(', '2026-05-03 10:11:12', NULL, 2);\n"
    )
    rows, rejected = read_dump(spark, str(path))
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"E1", "E2", "E4"}
    assert got["E1"].amount == 150000.0 and json.loads(got["E1"].billing)["a"] == "x, y"
    assert got["E1"].user_id is None and got["E1"].created_at.hour == 9
    assert got["E2"].company_id == "C'est; bien" and got["E2"].created_at is None and got["E2"].state is None
    assert got["E4"].company_id == "a\\b" and got["E4"].amount is None and got["E4"].state == 2
    bad = rejected.collect()
    assert [(r.found, r.expected) for r in bad] == [(2, 8)]


def test_dump_without_insert(spark, tmp_path):
    (tmp_path / "x.sql").write_text("SELECT 1;\n")
    with pytest.raises(ValueError):
        read_dump(spark, str(tmp_path / "x.sql"))


def test_latin1_dump(spark, tmp_path):
    path = tmp_path / "l.sql"
    path.write_bytes("INSERT INTO expenses (`id`, `source`) VALUES ('E1', 'Réseaux');\n".encode("latin-1"))
    assert read_dump(spark, str(path), encoding="ISO-8859-1")[0].first().source == "Réseaux"


def test_dump_batches(spark, ledger, tmp_path):
    out = str(tmp_path / "dump")
    write_dump(ledger.repartition(1), out, batch=30)
    text = "".join(p.read_text() for p in (tmp_path / "dump").glob("part-*"))
    assert len(re.findall("INSERT INTO", text)) == 4
    back, rejected = read_dump(spark, out)
    assert rejected.count() == 0
    assert back.exceptAll(ledger).count() == 0 and ledger.exceptAll(back.select(*ledger.columns)).count() == 0


def test_reports_by_suffix(spark, ledger, tmp_path):
    for name in ("r.csv", "r.json", "r.parquet"):
        write_report(ledger, str(tmp_path / name))
    back = read_csv_ledger(spark, str(tmp_path / "r.csv"))
    assert back.count() == 120 and back.where("amount = 9250000").count() == 1
    lines = [line for p in (tmp_path / "r.json").glob("part-*") for line in p.read_text().splitlines()]
    record = next(r for r in map(json.loads, lines) if r["id"] == "EXP_00000")
    assert record["created_at"].startswith("2025-11-03T08:20:00") and record["paid_at"] is None
    assert spark.read.parquet(str(tmp_path / "r.parquet")).count() == 120


@pytest.mark.parametrize("hot", [False, True])
def test_pseudonyms_are_consistent(spark, ledger, sliced, hot):
    cfg = {"cfg": sliced} if hot else {}
    out = privacy.pseudonymize(ledger, **cfg).collect()
    before = {r.amount: r for r in ledger.collect()}
    assert len(out) == 120 and {r.id for r in out} == {f"EXP_{i:05d}" for i in range(1, 121)}
    pairs = {(before[r.amount].user_id, r.user_id) for r in out}
    assert len(pairs) == 7 and ("AGENT_0", "USR_0001") in pairs
    assert sum(r.supplier_id is None for r in out) == 20


def test_billing(spark):
    method = "01" + "a" * 24
    rows = [
        ledger_row(0, billing='{"treasury_account_id": "T9", "method": "Jane Card", "address_id": "A"}'),
        ledger_row(1, billing=r'{\"treasury_account_id\": \"T9\", \"method\": \"' + method + r'\"}'),
        ledger_row(2, billing="broken"),
        ledger_row(3, billing=None),
        ledger_row(4, billing='{"z": {"deep": [1, "x"]}, "method": "cash", "n": 1.5, "treasury_account_id": "", "address_id": 7}'),
    ]
    out = {r.id: r.billing for r in privacy.sanitize_billing(frame(spark, rows), ("jane",)).collect()}
    assert json.loads(out["EXP_00004"]) == {
        "z": {"deep": [1, "x"]}, "method": "cash", "n": 1.5, "treasury_account_id": "", "address_id": None,
    }
    assert json.loads(out["EXP_00000"]) == {
        "treasury_account_id": "ACC_0001", "method": "Corporate account", "address_id": None,
    }
    assert json.loads(out["EXP_00001"])["method"] == "METH_0001"
    assert out["EXP_00002"] is None and out["EXP_00003"] is None


def test_anonymize_shifts_by_weeks(spark, ledger):
    out = privacy.anonymize(ledger)
    first = out.where("id = 'EXP_00001'").first()
    assert first.created_at.isoformat() == "2026-01-12T08:20:00" and first.items is None and first.shipping is None
    assert out.select("metadata").distinct().first().metadata == privacy.METADATA


def test_text_survives_dump_and_csv(spark, tmp_path):
    odd = ["p;\nq", "it's \\n here", "tab\r\nend\\", "a\\'b", "{x}; INSERT", 'q"u,o', "z"]
    df = frame(spark, [ledger_row(i, reference=t) for i, t in enumerate(odd)]).select("id", "reference", "amount")
    write_dump(df, str(tmp_path / "d.sql"))
    rows, rejected = read_dump(spark, str(tmp_path / "d.sql"))
    write_report(df, str(tmp_path / "d.csv"))
    for back in (rows, read_csv_ledger(spark, str(tmp_path / "d.csv"))):
        assert [r.reference for r in back.orderBy("id").collect()] == odd
    assert rejected.count() == 0


def test_every_tuple_is_read_or_rejected(spark, tmp_path):
    head = "INSERT INTO `expenses` (`id`,`amount`) VALUES "
    (tmp_path / "e.sql").write_bytes(
        f"{head}\r\n('a',1.0),\r\n('b',2.0);\r\n{head}('c',3.0); {head}('d',4), ({{\"k\": {{\"z\": 1}}}}, 5);\r\n".encode()
    )
    rows, rejected = read_dump(spark, str(tmp_path / "e.sql"))
    # Nested braces outside strings are a cell like any other.
    assert {r.id for r in rows.collect()} == {*"abcd", '{"k": {"z": 1}}'} and rejected.count() == 0


def test_aliases_outlive_an_export(spark, sliced):
    first = frame(spark, [ledger_row(i, user_id=u) for i, u in enumerate(["z", "a", None, " "])])
    later = frame(spark, [ledger_row(i, user_id=u) for i, u in enumerate(["new", "a", "z", "b"])])
    for cfg in ({}, {"cfg": sliced}):
        known = privacy.alias_dictionary(first, **cfg)
        grown = privacy.alias_dictionary(later, known, **cfg)
        users = {r.value: r.number for r in grown.where("kind = 'user_id'").collect()}
        assert users == {"z": 1, "a": 2, "new": 3, "b": 4}
        assert grown.count() == grown.select("kind", "value").distinct().count() == grown.select("kind", "number").distinct().count()
        out = privacy.pseudonymize(later, dictionary=grown, **cfg).orderBy("id").collect()
        assert [r.user_id for r in out] == ["USR_0003", "USR_0002", "USR_0001", "USR_0004"]
        assert privacy.alias_dictionary(later.limit(0), known, **cfg).count() == known.count()


def test_dump_in_another_encoding(spark, tmp_path):
    rows = [ledger_row(1, metadata="d\u00e9p\u00f4t; '\u00fc'\n")]
    write_dump(frame(spark, rows), str(tmp_path / "d"), encoding="ISO-8859-1")
    back, rejected = read_dump(spark, str(tmp_path / "d"), encoding="ISO-8859-1")
    assert [r.metadata for r in back.collect()] == [rows[0]["metadata"]] and rejected.count() == 0


def test_dump_pieces_are_bounded_and_blocks_known_once(spark, tmp_path):
    text = ["x" * (3 << 20)] * 4 + [None, "y", "z" * (9 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text)], ["n", "text"])
    cut = list(dump._bounded(iter([batch])))
    assert [t for piece in cut for t in piece.column(1).to_pylist()] == text
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= dump.PIECE_BYTES for p in cut)
    # A reading after the first one finds the blocks' states written.
    path = str(tmp_path / "dump")
    spark.createDataFrame([("INSERT INTO `expenses` (`id`) VALUES ('a;\\'b'), ('c');",)], "value string").write.text(path)
    rows = dump.read_dump(spark, path)[0]
    assert sorted(r["id"] for r in rows.collect()) == ["a;'b", "c"]
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().executedPlan().toString()


def test_lines_and_tuples_with_open_strings():
    assert dump.scan_line("a';'\\", dump.OUT) == (dump.OUT, [])
    assert dump.scan_line("'a\\", dump.OUT) == (dump.SINGLE, [])
    assert dump.scan_line("b'; \"c", dump.SINGLE) == (dump.DOUBLE, [2])
    assert dump.split_rows("(1, {'a': [\")\"]}), ('x") == ([["1", "{'a': [\")\"]}"]], ["('x"])
