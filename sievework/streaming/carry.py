"""Reports as a stream: an extension of batch parsing for lines that arrive in the order of each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

OUT = "file string, line_no long, severity string, rule_id string, raw_log string"
STATE = "severity string, rule_id string, last long"


def _take_up(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    severity, rule, last = state.get if state.exists else (None, None, -1)
    rows = pd.concat(list(batches)).sort_values("line_no")
    rows = rows[rows["line_no"] > last]  # a line that came before is not counted twice
    out = []
    for x in rows.itertuples():
        if x.kind == "severity":
            severity, rule = x.mark, None
        elif x.kind == "rule":
            rule = x.mark
        elif x.kind == "noise":
            rule = None
        elif x.kind == "instance" and rule is not None and severity is not None:
            out.append((key[0], x.line_no, severity, rule, x.raw_log))
        last = x.line_no
    state.update((severity, rule, int(last)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def stream_records(lines: DataFrame) -> DataFrame:
    """Records of a stream of ``lines`` (``file``, ``line_no``, ``value``); each file's severity and rule are its state.

    Lines are classified in the JVM; only those that matter to the state go to Python. Templates and variables are
    formed after it.
    """
    value = F.col("value")
    known = lines.withColumn("kind", T.kind(value)).where("kind <> 'skip'")
    mark = F.when(F.col("kind") == "severity", T.severity(value)).when(F.col("kind") == "rule", T.rule(value))
    shaped = known.select("file", "line_no", "kind", mark.alias("mark"), F.when(F.col("kind") == "instance", T.message(value)).alias("raw_log"))
    found = shaped.groupBy("file").applyInPandasWithState(_take_up, OUT, STATE, "append", "NoTimeout")
    return found.select("*", T.variables(F.col("raw_log")).alias("variables"), T.template(F.col("raw_log")).alias("template"))


def stream_counts(records: DataFrame) -> DataFrame:
    """Running counts of logic groups."""
    return records.groupBy("rule_id", T.signature(F.col("variables")).alias("pattern"), "template").agg(F.count(F.lit(1)).alias("total_count"))
