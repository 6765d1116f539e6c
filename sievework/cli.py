"""Commands over report files: group, cluster, score, measure, tune and view."""

from __future__ import annotations

import argparse
import json
from copy import deepcopy
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import view
from sievework.functions import text as T
from sievework.operators import config as C
from sievework.operators import distance, embed, evaluate, features, levels, parse, tuning
from sievework.plans import pipeline
from sievework.sources import reports
from sievework.storage import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievework", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for x in positional:
            p.add_argument(x.rstrip("?"), nargs="?" if x.endswith("?") else None)
        return p

    for p in (command("gca", "group a constraint report", "report"), command("cluster", "group a plain log", "log", "template?")):
        p.add_argument("--out", default="results.json")
        p.add_argument("--ai", choices=("auto", "on", "off"), default="auto")
        p.add_argument("--json-indent", type=int, default=2)
        p.add_argument("--max-original-logs", type=int, default=0)
        p.add_argument("--embeddings-config")
        p.add_argument("--rule-config")
        p.add_argument("--embedder", choices=("config", "hashing"), default="config")
    p = command("gca-eval", "score clusters against ground truth", "truth", "results", "logic")
    p.add_argument("--f1-threshold", type=float, default=evaluate.PASS_AT)
    for p in (command("gca-distances", "pairs of a rule by distance", "logic", "rule"), command("gca-fit-weights", "search weights of a rule", "logic", "rule", "truth"), command("gca-fit-adaptive-eps", "fit adaptive thresholds of a rule", "logic", "rule", "truth")):
        p.add_argument("--rule-config")
        p.add_argument("--embeddings-config")
        p.add_argument("--embedder", choices=("config", "hashing"), default="config")
        p.add_argument("--out")
    sub.choices["gca-distances"].add_argument("--truth")
    w = sub.choices["gca-fit-weights"]
    w.add_argument("--search-spec")
    w.add_argument("--variables")
    w.add_argument("--max-level-combo-size", type=int, default=2)
    w.add_argument("--top-k", type=int, default=10)
    a = sub.choices["gca-fit-adaptive-eps"]
    a.add_argument("--features")
    a.add_argument("--max-depth", type=int, default=7)
    a.add_argument("--max-min-samples-leaf", type=int, default=15)
    a.add_argument("--round-decimals", type=int, default=3)
    a.add_argument("--min-eps", type=float, default=0.001)
    v = command("view", "show results", "results")
    v.add_argument("--top", type=int, default=50)
    v.add_argument("--no-color", action="store_true")
    return top


def embedder_of(args, warn) -> tuple[embed.Embedder | None, str | None, int]:
    """The embedder, its name and its batch size; none if the local model isn't installed."""
    if args.embedder == "hashing":
        return embed.hashing(), "hashing", 512
    found = C.load_embeddings(C.embeddings_path(args.embeddings_config), warn=warn)
    if found.backend == "openai_compatible":
        return embed.remote(found), found.backend, found.batch_size
    try:
        return embed.local(), "local", found.batch_size
    except embed.EmbeddingError as e:
        warn(str(e))
        return None, None, found.batch_size


def rule_groups(logic: DataFrame, rule_id: str) -> DataFrame:
    """A rule's logic groups of a results file, numbered by their place."""
    own = logic.where((F.col("group_type") == "logic") & (F.col("rule_id") == rule_id))
    return own.select("rule_id", F.col("pos").cast("long").alias("gid"), "group_id", F.col("representative_template").alias("template"), F.col("representative_pattern").alias("pattern"), "total_count")


def rule_truth(spark: SparkSession, path: str, groups: DataFrame, rule_id: str) -> DataFrame:
    """``gid`` and ``cluster`` of a rule; raises if ids are missing, unknown or twice in the ground truth."""
    truth = reports.read_truth(spark, path).where(F.col("rule_id") == rule_id)
    problems = evaluate.truth_problems(truth, groups.withColumn("group_type", F.lit("logic"))).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r['problem']} {r['group_id']}" for r in problems))
    return truth.join(groups.select("group_id", "gid"), "group_id").select("gid", "cluster")


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sievework").getOrCreate()
    console = view.Console(False if getattr(args, "no_color", False) else None)
    warnings: list[str] = []
    warn = lambda text: (warnings.append(text), console.warn(text))
    try:
        return globals()[f"_{args.command.replace('-', '_')}"](spark, args, console, warn, warnings)
    except (OSError, ValueError, RuntimeError) as e:
        console.error(str(e))
        return 1


def _group(spark, args, console, warn, warnings, records: DataFrame, source: str, config: C.Config | None, **optional) -> int:
    embedder, backend, _ = embedder_of(args, warn) if args.ai != "off" else (None, None, 0)
    records = store(records, "records")
    out, used = pipeline.run(records, config, embedder, args.ai, args.max_original_logs, warn)
    out = store(out, "output")
    logic = records.select("rule_id", T.signature(F.col("variables")).alias("pattern"), "template").distinct().count()
    counts = {"parsed_logs": records.count(), "logic_groups": logic, "final_groups": out.count()}
    described = reports.run_description(source, counts, backend if used else None, warnings, **optional)
    reports.write_results(out, described, args.out, args.json_indent)
    console.pair("Groups", counts["final_groups"])
    console.pair("Written", args.out)
    return 0


def _gca(spark, args, console, warn, warnings) -> int:
    reports.require_readable(spark, args.report)
    config = C.config_at(args.rule_config)
    return _group(spark, args, console, warn, warnings, parse.records(reports.read_lines(spark, args.report)), args.report, config, sanity_item="gca")


def _cluster(spark, args, console, warn, warnings) -> int:
    reports.require_readable(spark, *filter(None, (args.log,)))
    if args.rule_config:
        warn("cluster takes no rule configuration; it is left aside")
    lines = reports.read_lines(spark, args.log)
    records = parse.legacy_records(lines, reports.read_dictionary(spark, args.template)) if args.template else parse.records(lines)
    return _group(spark, args, console, warn, warnings, records, args.log, None, template_file=args.template)


def _gca_eval(spark, args, console, warn, warnings) -> int:
    truth = reports.read_truth(spark, args.truth)
    scores = store(evaluate.evaluate(truth, reports.read_results(spark, args.results)[1], reports.read_results(spark, args.logic)[1], args.f1_threshold), "scores")
    console.info(view.scores_table(scores))
    return 0 if scores.where("not passed").isEmpty() else 1


def base_pairs(groups: DataFrame, config: C.Config, rule: C.Rule, embedder, adaptive: bool = True) -> DataFrame:
    if rule.pairwise_tree:
        return features.tree_pairs(groups, rule.pairwise_tree)
    if embedder is None:
        raise RuntimeError("distances need an embedder")
    base = distance.pairs(distance.items(groups, config, embedder))
    return features.adaptive_pairs(groups, base, rule.adaptive_eps_tree) if adaptive and rule.adaptive_eps_tree else base


def _gca_distances(spark, args, console, warn, warnings) -> int:
    groups = store(rule_groups(reports.read_results(spark, args.logic)[1], args.rule), "rule")
    if groups.isEmpty():
        raise ValueError(f"no logic groups of rule {args.rule}")
    config = C.config_at(args.rule_config)
    rule = config.rule(args.rule)
    embedder = None if rule.pairwise_tree else embedder_of(args, warn)[0]
    truth = rule_truth(spark, args.truth, groups, args.rule) if args.truth else spark.createDataFrame([], "gid long, cluster long")
    eps = 1.0 if rule.adaptive_eps_tree and not rule.pairwise_tree else rule.eps
    console.info(view.distances_text(evaluate.annotated_pairs(base_pairs(groups, config, rule, embedder), truth, eps), eps))
    paths = groups.select("gid", F.posexplode(T.slots(F.col("pattern"))).alias("var", "path"))
    signals = store(levels.level_signals(paths, truth if args.truth else None), "signals")
    for r in signals.orderBy("var", "level").toLocalIterator():
        console.info(f"variable {r['var']} level {r['level']}: {r['n_unique']} values, {r['signal']}")
    for r in levels.recommendations(signals).where("recommendation is not null").orderBy("var").toLocalIterator():
        console.info(f"variable {r['var']}: {r['recommendation']}")
    return 0


def _raw_config(path: str | None) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else deepcopy(C.BUNDLED)


def _write_config(path: str | None, raw: dict, console) -> None:
    text = json.dumps(raw, indent=2, ensure_ascii=False) + "\n"
    Path(path).write_text(text, encoding="utf-8") if path else console.info(text)


def _gca_fit_weights(spark, args, console, warn, warnings) -> int:
    if args.top_k < 1:
        raise ValueError("--top-k must be 1 or more")
    raw, config = _raw_config(args.rule_config), C.config_at(args.rule_config)
    groups = store(rule_groups(reports.read_results(spark, args.logic)[1], args.rule), "rule")
    truth = store(rule_truth(spark, args.truth, groups, args.rule), "truth")
    variables = [int(x) for x in args.variables.split(",")] if args.variables else None
    spec = json.loads(Path(args.search_spec).read_text(encoding="utf-8")) if args.search_spec else tuning.default_search(groups, config, args.rule, variables, args.max_level_combo_size)
    base = raw.get("rules", {}).get(args.rule, {})
    entries = tuning.candidates(spec, base, config.rule(args.rule), config.default_variable_weight)
    embedder = embedder_of(args, warn)[0]
    if embedder is None:
        raise RuntimeError("a search needs an embedder")
    scored = store(tuning.score_candidates(groups, truth, config, entries, embedder), "scored")
    expected = truth.select("cluster").distinct().count()
    console.info(view.search_text(tuning.best_first(scored, expected, args.top_k)))
    chosen = entries[tuning.best(scored, expected).first()["candidate"]]
    _write_config(args.out, tuning.with_rule(raw, args.rule, chosen), console)
    return 0


def _gca_fit_adaptive_eps(spark, args, console, warn, warnings) -> int:
    raw, config = _raw_config(args.rule_config), C.config_at(args.rule_config)
    groups = store(rule_groups(reports.read_results(spark, args.logic)[1], args.rule), "rule")
    truth = store(rule_truth(spark, args.truth, groups, args.rule), "truth")
    specs = C.load_features(args.features)
    rule = config.rule(args.rule)
    plain = C.Config(config.default_eps, config.default_template_weight, config.default_variable_weight, {args.rule: C.Rule(rule.eps, rule.template_weight, rule.variables)})
    base = base_pairs(groups, plain, plain.rule(args.rule), embedder_of(args, warn)[0])
    known = features.pair_features(groups, specs, base)
    tree, told = tuning.fit_adaptive(known, truth, specs, args.max_depth, args.max_min_samples_leaf, args.round_decimals, args.min_eps)
    console.info(f"F1 {told['f1']:.4f} P {told['precision']:.4f} R {told['recall']:.4f} nodes {told['n_nodes']} depth {told['depth']} leaf {told['leaf']}")
    _write_config(args.out, tuning.with_adaptive_tree(raw, args.rule, tree), console)
    return 0


def _view(spark, args, console, warn, warnings) -> int:
    described, groups = reports.read_results(spark, args.results)
    view.show_results(console, args.results, described, groups, args.top)
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
