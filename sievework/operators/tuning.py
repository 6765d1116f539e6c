"""Searches over rule configurations, and fitting of adaptive thresholds.

Distances of single components (a variable at some levels in a mode, or the template) don't depend on weights or
thresholds. They are formed once, and all candidates are scored from them in one job.
"""

from __future__ import annotations

import itertools
import json
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import evaluate
from sievework.operators.components import components
from sievework.operators.config import MATCH_MODES, Config, ConfigError, Rule, Slot, Tree, Variable, is_int, need, parse_rule, slot_plan
from sievework.operators.distance import BLOCK, dealt_blocks, forest, slot_distances, slot_text, weighted_mean
from sievework.operators.embed import Embedder, embed_texts

EPS_VALUES, TEMPLATE_VALUES = (0.05, 0.1, 0.15, 0.2, 0.3), (0.0, 0.2)
#: Nodes of one candidate's graph are numbered from its number times this.
SPAN = 1 << 32


def unique(values: list) -> list:
    """Without repeats, in order; objects by their JSON."""
    seen: dict[str, object] = {}
    for v in values:
        seen.setdefault(json.dumps(v, sort_keys=True), v)
    return list(seen.values())


def level_options(depth: int, size: int) -> list[list[int]]:
    """Runs of up to ``size`` neighbouring levels, counted from the end."""
    return [list(range(a, a + n)) for n in range(1, size + 1) for a in range(-depth, -n + 1)]


def default_search(groups: DataFrame, config: Config, rule_id: str, variables: list[int] | None = None, size: int = 2) -> dict:
    """A search around the rule in force, over thresholds, template weights and each variable's weights, modes, levels."""
    if size < 1:
        raise ConfigError("the size of level runs must be 1 or more")
    rule = config.rule(rule_id)
    own = groups.where(F.col("rule_id") == rule_id)
    cut = own.select(F.posexplode(T.slots(F.col("pattern"))).alias("var", "text"))
    deep = {r["var"]: r["depth"] for r in cut.groupBy("var").agg(F.max(F.size(T.path_parts(F.col("text")))).alias("depth")).collect()}  # a row per variable
    targets = sorted(set(variables if variables is not None else [*deep, *rule.variables]))
    found: dict[str, list[dict]] = {}
    for k in targets:
        now = rule.variables.get(k, Variable(config.default_variable_weight))
        levels: list[list[int] | None] = [None] + ([list(now.levels)] if now.levels is not None else []) + level_options(deep.get(k, 0), size)
        options: list[dict] = [{"weight": 0.0}]
        if now.level_weights is not None:
            options.append({"match_mode": now.match_mode, "level_weights": {str(a): w for a, w in now.level_weights}})
        for w in unique([now.weight, 1.0]):
            for mode in unique([now.match_mode, *MATCH_MODES]) if w else ():
                options += [{"weight": w, "match_mode": mode} | ({} if x is None else {"levels": x}) for x in levels]
        found[str(k)] = unique(options)
    return {"template_weight": unique([rule.template_weight, *TEMPLATE_VALUES]), "eps": unique([rule.eps, *EPS_VALUES]), "variables": found}


def check_search(spec: object) -> None:
    need(isinstance(spec, dict), "search", "must be an object")
    need(not set(spec) - {"template_weight", "eps", "variables"}, "search", "has unknown keys")
    for key in ("template_weight", "eps"):
        if key in spec:
            need(isinstance(spec[key], list) and spec[key], f"search.{key}", "must be a list with entries")
            need(all(isinstance(x, int | float) and not isinstance(x, bool) and x >= 0 for x in spec[key]), f"search.{key}", "must hold numbers of 0 or more")
    variables = spec.get("variables", {})
    need(isinstance(variables, dict), "search.variables", "must be an object")
    for k, v in variables.items():
        need(isinstance(k, str) and k.isdigit(), "search.variables", f"{k!r} is no variable number")
        need(isinstance(v, list) and v and all(isinstance(x, dict) for x in v), f"search.variables.{k}", "must be a list of objects")


def variable_candidate(raw: dict, now: Variable, default_weight: float) -> dict:
    """A variable's entry of a candidate. Without ``levels`` all levels are meant, and no weight is just off."""
    need(raw.get("levels") is None or "level_weights" not in raw, "search", "levels and level_weights exclude each other")
    mode = str(raw.get("match_mode", now.match_mode))
    need(mode in MATCH_MODES, "search", f"match_mode must be one of {MATCH_MODES}")
    weight = float(raw.get("weight", now.weight))
    need(weight >= 0, "search", "weights must be 0 or more")
    out: dict = {} if mode == "embedding" else {"match_mode": mode}
    if "level_weights" in raw:
        out["level_weights"] = {k: float(v) for k, v in raw["level_weights"].items()}
        return {"weight": 0.0} if default_weight == 0 else out
    if weight == 0:
        return {"weight": 0.0}
    if raw.get("levels") is not None:
        need(all(is_int(x) for x in raw["levels"]), "search", "levels must be whole numbers")
        out["levels"] = list(raw["levels"])
    return {"weight": weight} | out


def candidates(spec: dict, base: dict, rule: Rule, default_weight: float) -> list[dict]:
    """The product of a search as rule entries over the ``base`` entry, without repeats and without trees."""
    check_search(spec)
    lists = [(k, unique([variable_candidate(x, rule.variables.get(int(k), Variable(default_weight)), default_weight) for x in v])) for k, v in sorted(spec.get("variables", {}).items(), key=lambda x: int(x[0]))]
    kept = {k: v for k, v in base.items() if k not in ("pairwise_tree", "adaptive_eps_tree")}
    out = []
    for tw, eps, *chosen in itertools.product(spec.get("template_weight", [rule.template_weight]), spec.get("eps", [rule.eps]), *(v for _, v in lists)):
        entry = deepcopy(kept) | {"template_weight": float(tw), "eps": float(eps)}
        entry["variables"] = deepcopy(base.get("variables", {})) | {k: deepcopy(x) for (k, _), x in zip(lists, chosen, strict=True)}
        out.append(entry)
    return unique(out)


def summary(entry: dict) -> str:
    told = []
    for k, v in sorted(entry.get("variables", {}).items(), key=lambda x: int(x[0])):
        if "level_weights" in v:
            told.append(f"var{k}=level_weights@{v['level_weights']}")
        elif float(v.get("weight", 0.0)) == 0.0:
            told.append(f"var{k}=off")
        else:
            told.append(f"var{k}={v.get('match_mode', 'embedding')},w={float(v['weight'])}@{v['levels'] if v.get('levels') is not None else 'all'}")
    return f"eps={float(entry.get('eps', 0.0))} template_weight={float(entry.get('template_weight', 0.0))} {' '.join(told)}".strip()


def component_items(groups: DataFrame, plans: list[tuple], embedder: Embedder) -> DataFrame:
    """One rule's groups with a slot for each component (variable, levels, mode) of ``plans``."""
    made = [F.struct(F.lit(k).alias("slot"), slot_text(Slot(v, levels, 1.0, mode)).alias("text"), F.lit(mode).alias("mode")) for k, (v, levels, mode) in enumerate(plans)]
    rows = groups.select("gid", F.explode(F.array(*made)).alias("s")).select("gid", "s.*")
    rows = rows.withColumn("active", T.strip(F.col("text")) != "")
    vectors = embed_texts(rows.where("mode = 'embedding' and active"), embedder)
    slot = F.struct("slot", "text", "active", F.lit(1.0).alias("weight"), "mode", "vector")
    return rows.join(vectors, "text", "left").groupBy("gid").agg(F.sort_array(F.collect_list(slot)).alias("slots")).withColumn("key", F.lit(0))


def candidate_links(packed: DataFrame, weights: list[list[float]], eps: list[float], block: int = BLOCK) -> DataFrame:
    """``candidate``, ``i``, ``j``: the links that a candidate's components need.

    Where two blocks of groups meet, the components' distances are formed once and serve all candidates.
    """
    dealt = dealt_blocks(packed, "key", "gid", block).select("key", "x", "y", "own", "gid", "slots")

    def run(table):
        import pyarrow as pa

        rows = sorted(table.select(["gid", "own", "slots"]).to_pylist(), key=lambda r: r["gid"])
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = [r for r in rows if r["own"] == x], [r for r in rows if r["own"] == y]
        out: dict[str, list] = {"candidate": [], "i": [], "j": []}
        if left and right:
            slots = slot_distances([r["slots"] for r in left], [r["slots"] for r in right])
            a, b = np.array([r["gid"] for r in left]), np.array([r["gid"] for r in right])
            for c, (w, limit) in enumerate(zip(weights, eps, strict=True)):
                p, q = np.nonzero(weighted_mean(slots, w, (len(left), len(right))) <= limit)
                i, j = np.minimum(a[p], b[q]), np.maximum(a[p], b[q])
                kept = forest(i, j)
                out["candidate"] += [c] * len(kept)
                out["i"] += i[kept].tolist()
                out["j"] += j[kept].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return dealt.groupBy("key", "x", "y").applyInArrow(run, "candidate long, i long, j long")


def score_candidates(groups: DataFrame, truth: DataFrame, config: Config, entries: list[dict], embedder: Embedder) -> DataFrame:
    """Each candidate (``candidate``) with its scores, clusters and active components, all in one job.

    ``groups`` are one rule's, with ``gid`` under 2**32; ``truth`` has ``gid`` and ``cluster``.
    """
    spark = groups.sparkSession
    slots = [slot_plan(parse_rule(entry, config, f"candidate {c}")) for c, entry in enumerate(entries)]
    plans = list(dict.fromkeys((s.variable, s.levels, s.mode) for plan in slots for s in plan)) or [(-1, None, "jaccard")]
    weights = [[sum(s.weight for s in plan if (s.variable, s.levels, s.mode) == p) for p in plans] for plan in slots]
    heads = [(c, float(entry["eps"]), len(plan), summary(entry)) for c, (entry, plan) in enumerate(zip(entries, slots, strict=True))]
    head = spark.createDataFrame(heads, "candidate long, eps double, parts int, summary string")
    near = candidate_links(component_items(groups, plans, embedder), weights, [h[1] for h in heads])
    edges = near.select((F.col("candidate") * SPAN + F.col("i")).alias("a"), (F.col("candidate") * SPAN + F.col("j")).alias("b"))
    nodes = groups.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(entries) - 1).cast("long"))).alias("candidate")).withColumn("node", F.col("candidate") * SPAN + F.col("gid"))
    placed = nodes.join(components(edges), "node", "left").withColumn("predicted", F.coalesce("component", "node"))
    rows = placed.join(truth.select("gid", F.col("cluster").alias("truth")), "gid", "left").select("candidate", "truth", "predicted")
    sized = rows.groupBy("candidate").agg(F.count_distinct("predicted").alias("clusters"))
    return evaluate.scores(evaluate.pair_counts(rows, "candidate"), None).join(sized, "candidate").join(head, "candidate")


def best_first(scored: DataFrame, expected: int, top: int = 10) -> DataFrame:
    """The ``top`` candidates: by F1, precision, recall, nearness to the expected clusters, few components."""
    order = [F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc(F.abs(F.col("clusters") - expected)), F.asc("parts"), F.asc("candidate")]
    return scored.orderBy(*order).limit(top)


def best(scored: DataFrame, expected: int) -> DataFrame:
    """The candidate to take; equal ones by their summary."""
    order = [F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc(F.abs(F.col("clusters") - expected)), F.asc("parts"), F.asc("summary")]
    return scored.orderBy(*order).limit(1)


def with_rule(config: dict, rule_id: str, entry: dict) -> dict:
    """The raw configuration with a rule replaced; its trees go."""
    out = deepcopy(config)
    out.setdefault("rules", {})[rule_id] = {k: v for k, v in deepcopy(entry).items() if k not in ("pairwise_tree", "adaptive_eps_tree")}
    return out


def with_adaptive_tree(config: dict, rule_id: str, tree: Tree) -> dict:
    """The raw configuration with a rule's adaptive tree set: its threshold is 1, and a pairwise tree goes."""
    out = deepcopy(config)
    entry = out.setdefault("rules", {}).setdefault(rule_id, {})
    entry.pop("pairwise_tree", None)
    entry |= {"eps": 1.0, "adaptive_eps_tree": {"features": [dict(f) for f in tree.features], "nodes": [dict(n) for n in tree.nodes]}}
    parse_rule(entry, Config(), f"rules.{rule_id}")
    return out


@dataclass
class Cart:
    """A classification tree: by node the feature (-1: leaf), threshold and children."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    leaf_of: np.ndarray


def fit_cart(x: np.ndarray, y: np.ndarray, max_depth: int, min_leaf: int) -> Cart:
    """Splits by the least Gini impurity; ties go to the lowest feature, then the lowest threshold."""
    tree = Cart([], [], [], [], np.zeros(len(y), dtype=np.int64))

    def grow(rows: np.ndarray, depth: int) -> int:
        node = len(tree.feature)
        for column in (tree.feature, tree.left, tree.right):
            column.append(-1)
        tree.threshold.append(0.0)
        n, k = len(rows), int(y[rows].sum())
        best_split = None
        if depth < max_depth and n >= 2 * min_leaf and 0 < k < n:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                at = np.arange(1, n)
                ok = (v[1:] > v[:-1]) & (at >= min_leaf) & (n - at >= min_leaf)
                if not ok.any():
                    continue
                a, b = ones[:-1] / at, (k - ones[:-1]) / (n - at)
                impurity = np.where(ok, at * a * (1 - a) + (n - at) * b * (1 - b), np.inf)
                s = int(np.argmin(impurity))
                if best_split is None or impurity[s] < best_split[0] - 1e-12:
                    best_split = (impurity[s], f, (float(v[s]) + float(v[s + 1])) / 2)
        if best_split is None:
            tree.leaf_of[rows] = node
            return node
        _, f, t = best_split
        tree.feature[node], tree.threshold[node] = f, t
        go = x[rows, f] <= t
        tree.left[node] = grow(rows[go], depth + 1)
        tree.right[node] = grow(rows[~go], depth + 1)
        return node

    grow(np.arange(len(y)), 0)
    return tree


def leaf_eps(leaf: np.ndarray, y: np.ndarray, dist: np.ndarray, digits: int, min_eps: float) -> dict[int, float]:
    out = {}
    for k in np.unique(leaf):
        pos, neg = dist[(leaf == k) & (y == 1)], dist[(leaf == k) & (y == 0)]
        half = max(min_eps, 0.5 * float(neg.min())) if len(neg) else min_eps
        if not len(neg):
            eps = float(pos.max())
        elif not len(pos):
            eps = half
        elif pos.max() < neg.min():
            eps = (float(pos.max()) + float(neg.min())) / 2
        else:
            eps = float(pos.max()) if len(pos) >= len(neg) else half
        out[int(k)] = max(min_eps, round(eps, digits))
    return out


def to_tree(cart: Cart, values: dict[int, float], specs: tuple[dict, ...], digits: int) -> Tree:
    """The tree with rounded thresholds and a leaf's threshold as its value."""
    nodes = [{"value": values[k]} if f < 0 else {"feature": f, "threshold": round(cart.threshold[k], digits), "left": cart.left[k], "right": cart.right[k]} for k, f in enumerate(cart.feature)]
    return Tree(specs, tuple(nodes))


def evaluate_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        n = tree.nodes[k]
        if "value" in n:
            out[rows] = n["value"]
        else:
            go = x[rows, n["feature"]] <= n["threshold"]
            todo += [(n["left"], rows[go]), (n["right"], rows[~go])]
    return out


def partition_scores(labels: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of the components of the pairs that are ``near``, from counts of pairs."""
    top = np.arange(len(labels))
    for a, b in zip(i[near], j[near], strict=True):
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        top[max(a, b)] = min(a, b)
    for k in range(len(top)):
        top[k] = top[top[k]]
    count = lambda *c: sum(n * (n - 1) // 2 for n in np.unique(np.stack(c), axis=1, return_counts=True)[1])
    tp, p, t = count(labels, top), count(top), count(labels)
    precision, recall = (tp / p if p else 1.0), (tp / t if t else 1.0)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def fit_adaptive(pairs_known: DataFrame, truth: DataFrame, specs: tuple[dict, ...], max_depth: int = 7, max_min_leaf: int = 15, digits: int = 3, min_eps: float = 0.001) -> tuple[Tree, dict]:
    """The best tree over depths and leaf sizes for pairs with features ``f0``, ... and ``dist``.

    The pairs are those of one rule's labelled groups, which people label by hand; they are sent to each task of the
    grid, which fits one tree.
    """
    if digits > 3 or round(min_eps, 3) != min_eps or min_eps <= 0:
        raise ConfigError("thresholds have 3 decimals at most, and the least one is over 0")
    need(max_depth >= 1 and max_min_leaf >= 1, "fit", "depth and leaf size must be 1 or more")
    names = [f"f{k}" for k in range(len(specs))]
    rows = pairs_known.select("i", "j", "dist", *names).orderBy("i", "j").toPandas()
    told = truth.select("gid", "cluster").orderBy("gid").toPandas()
    place = {g: k for k, g in enumerate(told["gid"])}
    labels = np.unique(told["cluster"].astype(str), return_inverse=True)[1]
    i, j = rows["i"].map(place).to_numpy(), rows["j"].map(place).to_numpy()
    x, dist = rows[names].to_numpy(dtype=np.float32), rows["dist"].to_numpy(dtype=np.float32)
    y = (labels[i] == labels[j]).astype(np.int64)
    grid = pairs_known.sparkSession.createDataFrame([(d, m) for d in range(1, max_depth + 1) for m in range(1, max_min_leaf + 1)], "depth int, leaf int").repartition(16)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for d, m in zip(pdf["depth"], pdf["leaf"], strict=True):
                cart = fit_cart(x, y, int(d), int(m))
                tree = to_tree(cart, leaf_eps(cart.leaf_of, y, dist, digits, min_eps), specs, digits)
                p, r, f1 = partition_scores(labels, i, j, dist / evaluate_tree(tree, x).astype(np.float32) <= 1.0)
                out.append((int(d), int(m), p, r, f1, len(tree.nodes), json.dumps([dict(n) for n in tree.nodes])))
            yield pd.DataFrame(out, columns=["depth", "leaf", "precision", "recall", "f1", "n_nodes", "nodes"])

    fitted = grid.mapInPandas(run, "depth int, leaf int, precision double, recall double, f1 double, n_nodes int, nodes string")
    top = fitted.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "n_nodes", "depth", F.desc("leaf")).first()
    return Tree(specs, tuple(json.loads(top["nodes"]))), top.asDict()
