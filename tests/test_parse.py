"""Parsing of reports: context, resets, dictionaries, streams."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import logic, parse
from sievework.sources import reports
from sievework.streaming.carry import stream_records

REPORT = """****************
Report : constraints
 error                  62   0
  CGR_0018          46    0 Clock 'clk1' is generated from 'clk2'
       1 of 46          0    Clock 'GEN_A' is generated from 'MSTR'
       2 of 46          0    Clock 'GEN_B' is generated from 'MSTR'
       3 of 46          0    Clock 'GEN_C' is generated from 'MSTR'
  CGR_0002          2     0 No variables
       1 of 2           0    Something without variables
       2 of 2           0    Clock 'x' has 3
-------
 Warning                 5   0
  CLK_0035           2
       1 of 2           0    Clock 'a1' late
       2 of 2           0    Clock 'a2' late
"""


def lines(spark, text, file="f"):
    rows = [(file, k, x) for k, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, value string").repartition(3)


def parsed(spark, text, **more):
    return parse.records(lines(spark, text), **more).orderBy("line_no").collect()


@pytest.mark.parametrize("block", [1, 2, 3, 100_000])
def test_golden_report(spark, block):
    got = parsed(spark, REPORT, block_lines=block)
    assert [r.rule_id for r in got] == ["CGR_0018"] * 3 + ["CGR_0002"] * 2 + ["CLK_0035"] * 2
    assert [r.severity for r in got] == ["error"] * 5 + ["warning"] * 2
    assert (got[0].variables, got[0].template, got[0].raw_log) == (["GEN_A", "MSTR"], "Clock '<VAR>' is generated from '<VAR>'", "Clock 'GEN_A' is generated from 'MSTR'")
    assert got[3].variables == ["NO_VAR"]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("  1 of 2  0  Clock 'a'", 0), (" error 1 0\n  1 of 2  0  Clock 'a'", 0), ("  CGR_0018 2 0 x\n  1 of 2  0  Clock 'a'", 0),
        (" error 1 0\n  CGR_0018 2 0 x\n  1 of 2  0  a\nScenario: slow\n  2 of 2  0  b", 1), (" error 1 0\n  CGR_0018 2 0 x\n  1 of 2  0  a\nScenario: slow\n  CGR_0019 2 0 x\n  2 of 2  0  b", 2),
        (" error 1 0\n  CGR_0018 2 0 x\n----\n\n  1 of 2  0  a", 1), (" error 1 0\n  CGR_0018 2 0 x\n info 1 0\n  1 of 2  0  a", 0), ("", 0),
    ],
)
def test_context(spark, text, n):
    assert len(parsed(spark, text)) == n


def test_files_do_not_mix(spark):
    both = lines(spark, REPORT, "a").unionByName(lines(spark, "  1 of 2  0  Clock 'a'", "b"))
    assert {r.file for r in parse.records(both).collect()} == {"a"}


def test_counters(spark):
    r = parse.run_counters(lines(spark, REPORT)).first()
    assert (r.instances, r.severities, r.rules, r.skipped) == (7, 2, 3, 4)


def test_groups(spark):
    records = parse.records(lines(spark, REPORT))
    got = {(r.rule_id, r.pattern): r.total_count for r in logic.logic_groups(records).collect()}
    assert got == {("CGR_0018", "GEN_A / MSTR"): 1, ("CGR_0018", "GEN_B / MSTR"): 1, ("CGR_0018", "GEN_C / MSTR"): 1, ("CGR_0002", "NO_VAR"): 1, ("CGR_0002", "x"): 1, ("CLK_0035", "a*"): 2}
    out = logic.output_groups(logic.logic_groups(records), records, 1).orderBy("seq").collect()
    assert out[0].group_id == "CLK_0035::logic::000001" and out[0].original_logs == ["Clock 'a1' late"]
    assert [r.seq for r in out] == list(range(1, 7))


def entries(spark):
    rows = [("R001", "Signal 'u_top' not found", 1), ("R002", "Signal 'u_cpu' not found", 2), ("R003", "Clock 'a' late by 3", 3)]
    return spark.createDataFrame(rows, "rule_id string, message string, line_no long")


def test_dictionary(spark):
    logs = spark.createDataFrame([("Signal 'u_top' not found ",), ("Signal 'u_cpu' not found",), ("Signal 'other' not found",), ("Clock 'b' late by 9",)], "raw_log string")
    got = {r.raw_log.strip(): r.rule_id for r in parse.resolve_rules(logs, entries(spark)).collect()}
    assert got["Signal 'u_top' not found"] == "R001" and got["Signal 'u_cpu' not found"] == "R002"
    assert got["Signal 'other' not found"].startswith("UNKNOWN_") and got["Clock 'b' late by 9"] == "R003"
    assert [r.template for r in parse.ambiguous_templates(entries(spark)).collect()] == ["Signal '<VAR>' not found"]


def test_legacy_log(spark):
    text = "Rule Severity\n====\n  4 of 4  0  Clock 'b' late by 9\n text\n"
    got = parse.legacy_records(lines(spark, text), entries(spark)).collect()
    assert [(r.rule_id, r.severity, r.variables) for r in got] == [("R003", None, ["b"])]


def test_files_keep_line_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.rpt").write_bytes(REPORT.encode() + b"\xff\n" * 3)
    (tmp_path / "dict.txt").write_text("Rule Severity Header Message\n----\nR001 HIGH INFO Clock 'a' late\nshort line\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = reports.read_lines(spark, str(tmp_path / "*.rpt"))
        assert parse.records(found).count() == 14
        first = found.where(F.col("file").endswith("a.rpt")).orderBy("line_no").limit(3).collect()
        assert [r.value for r in first] == REPORT.split("\n")[:3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.rule_id, r.message) for r in reports.read_dictionary(spark, str(tmp_path / "dict.txt")).collect()] == [("R001", "Clock 'a' late")]
    assert reports.read_dictionary(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(FileNotFoundError):
        reports.require_readable(spark, str(tmp_path / "none.txt"))


def test_stream_agrees_with_batch(spark, tmp_path):
    whole = [("f", k, x) for k, x in enumerate(REPORT.split("\n"))]
    schema = "file string, line_no long, value string"
    for k, part in enumerate((whole[:6], whole[6:12], whole[12:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = stream_records(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = found.writeStream.format("memory").queryName("stream_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("stream_out").orderBy("line_no").collect()
    assert [(r.line_no, r.rule_id, r.severity, r.template) for r in got] == [(r.line_no, r.rule_id, r.severity, r.template) for r in parsed(spark, REPORT)]
