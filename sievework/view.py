"""Reports for reading: groups, scores, distances and searches as text."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame

KEY_WIDTH = 24
PREVIEW = 5


class Console:
    """Prints sections and pairs; colours unless NO_COLOR is set or the output is no terminal."""

    def __init__(self, colour: bool | None = None, out: Callable[[str], None] = print):
        self.colour = colour if colour is not None else "NO_COLOR" not in os.environ and sys.stdout.isatty()
        self.out = out

    def _paint(self, code: int, text: str) -> str:
        return f"\033[{code}m{text}\033[0m" if self.colour else text

    def section(self, title: str) -> None:
        self.out(self._paint(1, f"== {title} =="))

    def pair(self, key: str, value: object) -> None:
        self.out(f"{key:<{KEY_WIDTH}}: {value}")

    def info(self, text: str) -> None:
        self.out(text)

    def warn(self, text: str) -> None:
        self.out(self._paint(33, f"warning: {text}"))

    def error(self, text: str) -> None:
        print(self._paint(31, f"error: {text}"), file=sys.stderr)


def show_results(console: Console, path: str, run: dict | None, groups: DataFrame, top: int = 50) -> None:
    """What the file holds, how it was made, and its first ``top`` groups, a line for each and its logs under it."""
    from pyspark.sql import functions as F

    whole = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_count"), F.lit(0)).alias("logs")).first()
    shown = min(whole["n"], max(0, top))
    console.section(f"{path}: {whole['n']} groups of {whole['logs']} logs")
    console.pair("format", 2 if run else 1)
    if run:
        for key, name in (("made at", "timestamp_utc"), ("from log", "log_file"), ("with templates", "template_file")):
            if run.get(name):
                console.pair(key, run[name])
        counts = run["counts"]
        console.pair("logs > logic > final", f"{counts['parsed_logs']} > {counts['logic_groups']} > {counts['final_groups']}")
        console.pair("second stage", (run["ai"].get("backend") or "on") if run["ai"]["enabled"] else "off")
        for text in run["ai"].get("warnings") or ():
            console.warn(text)
    for place, g in enumerate(groups.orderBy("pos").limit(shown).toLocalIterator(), 1):
        logs = g["original_logs"] or []
        console.section(f"{place}. {g['rule_id'] or '?'} x {g['total_count'] or 0}")
        console.pair(g["group_type"] or "logic", g["representative_pattern"] or "-")
        console.pair("template", g["representative_template"] or "-")
        console.pair("variants, logs kept", f"{g['merged_variants_count'] or 1}, {len(logs)}")
        for log in logs[:PREVIEW]:
            console.info(f"    {log}")
        if len(logs) > PREVIEW:
            console.info(f"    and {len(logs) - PREVIEW} others")
    if whole["n"] > shown:
        console.info(f"{whole['n'] - shown} groups are not shown; --top sets how many are")


def scores_table(scores: DataFrame) -> str:
    lines = [f"{'Rule':<16}{'TP':>8}{'FP':>8}{'FN':>8}{'P':>9}{'R':>9}{'F1':>9}  Result"]
    for r in scores.orderBy("rule_id").toLocalIterator():
        lines.append(f"{r['rule_id']:<16}{r['tp']:>8}{r['fp']:>8}{r['fn']:>8}{r['precision']:>9.4f}{r['recall']:>9.4f}{r['f1']:>9.4f}  {'PASS' if r['passed'] else 'FAIL'}")
    return "\n".join(lines)


def distances_text(pairs: DataFrame, eps: float) -> str:
    """All pairs by distance with a line where the threshold lies."""
    lines, marked = [], False
    for r in pairs.orderBy("dist", "i", "j").toLocalIterator():
        if not marked and r["dist"] > eps:
            lines.append(f"---- eps {eps} ----")
            marked = True
        lines.append(f"{r['dist']:.6f}  {r['i']}  {r['j']}  {'merge' if r['merge'] else 'apart'}  {'same' if r['gt_same_cluster'] else 'other'}")
    return "\n".join(lines)


def search_text(top: DataFrame) -> str:
    return "\n".join(f"F1 {r['f1']:.4f} P {r['precision']:.4f} R {r['recall']:.4f} clusters {r['clusters']} components {r['parts']}  {r['summary']}" for r in top.toLocalIterator())
