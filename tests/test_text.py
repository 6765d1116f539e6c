"""Column expressions against golden values."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T


def value(spark, column, **columns):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        (" error                  62   0", "severity"), ("WARNING 1 2", "severity"), ("  CGR_0018          46    0 Clock 'a' is", "rule"), ("  DES_0004                12206", "rule"),
        ("  HIER_001 3 0 x", "rule"), ("     1 of 46   0    Clock 'A'", "instance"), ("", "skip"), ("   ", "skip"), ("-----", "skip"), ("=====", "skip"), ("****", "skip"),
        ("Scenario: slow", "noise"), ("        CGR_0018 4 0 x", "noise"), ("error in clock 3", "noise"), ("1 of 2 words", "noise"), ("cgr_0018 4 0 x", "noise"),
    ],
)
def test_line_kinds(spark, line, kind):
    assert value(spark, T.kind(F.col("line")), line=line) == kind


@pytest.mark.parametrize(
    ("text", "template", "found"),
    [
        ("   Path 'foo/bar_1' count 12 exceeds 3   ", "Path '<VAR>' count <NUM> exceeds <NUM>", ["foo/bar_1"]),
        ("no clocks bar_1 7", "no clocks bar_1 <NUM>", ["NO_VAR"]),
        ("'' is 5é 5", "'<VAR>' is 5é <NUM>", [""]),
    ],
)
def test_templates_and_variables(spark, text, template, found):
    assert value(spark, T.template(F.col("t")), t=text) == template
    assert value(spark, T.variables(F.col("t")), t=text) == found


@pytest.mark.parametrize(("found", "signature"), [(["pipe_4", "pipe_55"], "pipe_* / pipe_*"), (["NO_VAR"], "NO_VAR"), ([], "NO_VAR"), (["a1b22", ""], "a*b* / ")])
def test_signature(spark, found, signature):
    assert value(spark, T.signature(F.col("v")), v=found) == signature


@pytest.mark.parametrize(
    ("path", "levels", "chosen"),
    [("top/cpu/alu/pipe", [0, -1], "top pipe"), ("top/cpu/alu/pipe", [-2, -1], "alu pipe"), ("top/cpu/alu/pipe", None, "top cpu alu pipe"), ("a/b", [0, 5], "a"), ("a/b", [5, 6], ""), ("a/b", [], ""), ("a/b", [-3], "")],
)
def test_levels(spark, path, levels, chosen):
    assert value(spark, T.select_levels(F.col("p"), levels), p=path) == chosen


def test_slots_trim_first(spark):
    assert value(spark, T.slots(F.col("p")), p=" / x") == ["/ x"]
    assert value(spark, T.slots(F.col("p")), p="'a' / b  /  c") == ["'a'", "b", "c"]


def test_segments(spark):
    path = "u_top/blk_12/data__MBIT_rest/reg_3/CK"
    assert value(spark, T.segment_tokens(F.col("p")), p=path) == [["DATA"], ["CK"]]
    assert value(spark, T.path_document(F.col("p")), p=path) == "DATA / CK"


def test_unknown_rule_and_short_id(spark):
    import hashlib

    assert value(spark, T.unknown_rule(F.col("t")), t="abc") == "UNKNOWN_" + hashlib.md5(b"abc").hexdigest()[:6].upper()
    assert value(spark, T.short_id(F.col("t")), t="CGR_0018::logic::000001") == "CGR_0018::logic::000001"
    assert value(spark, T.short_id(F.col("t")), t="A_VERY_LONG_RULE::logic::000001") == "..000001"


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(T.jaccard_distance(F.col("a"), F.col("b"))).collect()] == [1 - 1 / 3, 0.0, 1.0]
    assert [r[0] for r in rows.select(T.jaccard_similarity(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]


def test_quotes_in_token_sets(spark):
    assert value(spark, T.bare_token_set(F.col("t")), t="'a b' b  \"c\"") == ["a", "b", "c"]
    assert value(spark, T.token_set(F.col("t")), t="'a b' b") == ["'a", "b'", "b"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(T.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0], abs=1e-12)


def test_coercions(spark):
    assert value(spark, T.first_non_empty(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
    assert value(spark, T.to_int(F.col("a"), 3), a="q") == 3
