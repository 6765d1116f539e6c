"""Configuration of rules, trees, searches and embeddings, with checks."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

#: The configuration's keys and defaults.
DEFAULT_EPS, DEFAULT_TEMPLATE_WEIGHT, DEFAULT_VARIABLE_WEIGHT, LITERAL_VARIABLE_WEIGHT = 0.2, 0.3, 0.7, 0.7
TOP_KEYS = {"default_eps", "default_template_weight", "default_variable_weight", "rules"}
RULE_KEYS = {"eps", "template_weight", "variables", "pairwise_tree", "adaptive_eps_tree"}
VARIABLE_KEYS = {"weight", "levels", "level_weights", "match_mode"}
MATCH_MODES = ("embedding", "jaccard")
FEATURE_KEYS = {"kind", "levels", "ngram_range", "max_shift", "decay"}
FEATURE_KINDS = ("path_tfidf_char_wb", "suffix_similarity", "level_jaccard", "level_exact", "path_length_equal", "path_length_diff")
SPLIT_KEYS = {"feature", "threshold", "left", "right"}
DECIMALS = 3
DEFAULT_FEATURES = (
    {"kind": "path_tfidf_char_wb", "ngram_range": [3, 6]},
    {"kind": "suffix_similarity", "max_shift": 3, "decay": 0.65},
    {"kind": "level_jaccard", "levels": [-4, -3]},
    {"kind": "path_length_diff"},
)
#: The rules in force where no configuration is named.
BUNDLED = {
    "default_eps": 0.2, "default_template_weight": 0.3, "default_variable_weight": 0.7,
    "rules": {
        "CGR_0018": {"eps": 0.04, "template_weight": 0, "variables": {"0": {"weight": 0}, "1": {"weight": 1.0}}},
        "DES_0001": {
            "eps": 1.0, "template_weight": 0,
            "adaptive_eps_tree": {
                "features": [{"kind": "path_tfidf_char_wb", "ngram_range": [3, 6]}, {"kind": "suffix_similarity", "max_shift": 3, "decay": 0.65}],
                "nodes": [
                    {"feature": 0, "threshold": 0.369, "left": 1, "right": 4},
                    {"feature": 0, "threshold": 0.306, "left": 2, "right": 3},
                    {"value": 0.001},
                    {"value": 0.147},
                    {"feature": 0, "threshold": 0.563, "left": 5, "right": 8},
                    {"feature": 1, "threshold": 0.621, "left": 6, "right": 7},
                    {"value": 0.543},
                    {"value": 0.014},
                    {"feature": 0, "threshold": 0.611, "left": 9, "right": 10},
                    {"value": 0.393},
                    {"value": 0.396},
                ],
            },
            "variables": {"0": {"weight": 1.0, "levels": [-2], "match_mode": "embedding"}},
        },
    },
}


class ConfigError(ValueError):
    """A configuration that can't be used; says where and why."""


def need(true: bool, where: str, what: str) -> None:
    if not true:
        raise ConfigError(f"{where}: {what}")


def is_number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def is_int(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def decimals(x: float) -> int:
    return max(0, -Decimal(str(x)).normalize().as_tuple().exponent)


@dataclass(frozen=True)
class Variable:
    weight: float = LITERAL_VARIABLE_WEIGHT
    levels: tuple[int, ...] | None = None
    level_weights: tuple[tuple[int, float], ...] | None = None
    match_mode: str = "embedding"


@dataclass(frozen=True)
class Tree:
    features: tuple[dict, ...]
    nodes: tuple[dict, ...]


@dataclass(frozen=True)
class Rule:
    eps: float = DEFAULT_EPS
    template_weight: float = DEFAULT_TEMPLATE_WEIGHT
    variables: Mapping[int, Variable] = field(default_factory=dict)
    pairwise_tree: Tree | None = None
    adaptive_eps_tree: Tree | None = None


@dataclass(frozen=True)
class Slot:
    """A compared text: a variable at some levels, or the template (variable -1)."""

    variable: int
    levels: tuple[int, ...] | None
    weight: float
    mode: str


@dataclass(frozen=True)
class Config:
    default_eps: float = DEFAULT_EPS
    default_template_weight: float = DEFAULT_TEMPLATE_WEIGHT
    default_variable_weight: float = DEFAULT_VARIABLE_WEIGHT
    rules: Mapping[str, Rule] = field(default_factory=dict)

    def rule(self, rule_id: str) -> Rule:
        return self.rules.get(rule_id) or Rule(self.default_eps, self.default_template_weight)


def _only(raw: Mapping, allowed: set[str], where: str) -> None:
    unknown = sorted(set(raw) - allowed)
    need(not unknown, where, f"unknown keys {unknown}")


def _weight(x: object, where: str) -> float:
    need(is_number(x) and x >= 0, where, "must be a number of 0 or more")
    return float(x)


def parse_variable(raw: object, where: str) -> Variable:
    need(isinstance(raw, dict), where, "must be an object")
    _only(raw, VARIABLE_KEYS, where)
    need(raw.get("levels") is None or raw.get("level_weights") is None, where, "levels and level_weights exclude each other")
    levels, by_level = raw.get("levels"), raw.get("level_weights")
    if levels is not None:
        need(isinstance(levels, list) and all(is_int(x) for x in levels), f"{where}.levels", "must be a list of whole numbers")
    if by_level is not None:
        need(isinstance(by_level, dict) and by_level, f"{where}.level_weights", "must be an object with entries")
        for k in by_level:
            need(isinstance(k, str) and k.strip().lstrip("-").isdigit(), f"{where}.level_weights", f"{k!r} is no whole number")
        by_level = tuple(sorted((int(k), _weight(v, f"{where}.level_weights.{k}")) for k, v in by_level.items()))
    mode = raw.get("match_mode", "embedding")
    need(mode in MATCH_MODES, f"{where}.match_mode", f"must be one of {MATCH_MODES}")
    return Variable(_weight(raw.get("weight", LITERAL_VARIABLE_WEIGHT), f"{where}.weight"), tuple(levels) if levels is not None else None, by_level, mode)


def parse_feature(raw: object, where: str) -> dict:
    need(isinstance(raw, dict), where, "must be an object")
    _only(raw, FEATURE_KEYS, where)
    need(raw.get("kind") in FEATURE_KINDS, f"{where}.kind", f"must be one of {FEATURE_KINDS}")
    if raw.get("levels") is not None:
        need(isinstance(raw["levels"], list) and all(is_int(x) for x in raw["levels"]), f"{where}.levels", "must be a list of whole numbers")
    if "ngram_range" in raw:
        r = raw["ngram_range"]
        need(isinstance(r, list) and len(r) == 2 and all(is_int(x) for x in r) and 1 <= r[0] <= r[1], f"{where}.ngram_range", "must be two rising whole numbers from 1")
    if "max_shift" in raw:
        need(is_int(raw["max_shift"]) and raw["max_shift"] >= 0, f"{where}.max_shift", "must be a whole number of 0 or more")
    if "decay" in raw:
        need(is_number(raw["decay"]) and 0 < raw["decay"] <= 1, f"{where}.decay", "must be in (0, 1]")
    return dict(raw)


def parse_tree(raw: object, where: str, adaptive: bool) -> Tree:
    """A tree as a flat list of nodes, root first. Leaves are 0 or 1, or for an adaptive tree numbers over 0."""
    need(isinstance(raw, dict), where, "must be an object")
    _only(raw, {"features", "nodes"}, where)
    features, nodes = raw.get("features"), raw.get("nodes")
    need(isinstance(features, list) and features, f"{where}.features", "must be a list with entries")
    need(isinstance(nodes, list) and nodes, f"{where}.nodes", "must be a list with entries")
    features = tuple(parse_feature(x, f"{where}.features[{k}]") for k, x in enumerate(features))
    for k, node in enumerate(nodes):
        at = f"{where}.nodes[{k}]"
        need(isinstance(node, dict), at, "must be an object")
        if "value" in node:
            _only(node, {"value"}, at)
            x = node["value"]
            need(is_number(x), at, "value must be a number")
            if adaptive:
                need(x > 0 and decimals(x) <= DECIMALS, at, f"value must be over 0 with {DECIMALS} decimals at most")
            else:
                need(x in (0, 1), at, "value must be 0 or 1")
        else:
            need(set(node) == SPLIT_KEYS, at, f"needs exactly {sorted(SPLIT_KEYS)}")
            need(all(is_int(node[x]) for x in ("feature", "left", "right")), at, "feature, left and right must be whole numbers")
            need(is_number(node["threshold"]) and decimals(node["threshold"]) <= DECIMALS, at, f"threshold must have {DECIMALS} decimals at most")
    state: dict[int, int] = {}
    todo = [(0, False)]
    while todo:  # every path from the root must end
        k, left = todo.pop()
        if left:
            state[k] = 2
            continue
        need(0 <= k < len(nodes), where, f"there is no node {k}")
        need(state.get(k) != 1, where, f"node {k} is on a cycle")
        if state.get(k) == 2 or "value" in nodes[k]:
            continue
        need(0 <= nodes[k]["feature"] < len(features), where, f"node {k} names no feature")
        state[k] = 1
        todo += [(k, True), (nodes[k]["right"], False), (nodes[k]["left"], False)]
    return Tree(features, tuple(dict(n) for n in nodes))


def parse_rule(raw: object, config: Config, where: str) -> Rule:
    need(isinstance(raw, dict), where, "must be an object")
    _only(raw, RULE_KEYS, where)
    variables = raw.get("variables", {})
    need(isinstance(variables, dict), f"{where}.variables", "must be an object")
    parsed = {}
    for k, v in variables.items():
        need(isinstance(k, str) and k.isdigit(), f"{where}.variables", f"{k!r} is no variable number")
        parsed[int(k)] = parse_variable(v, f"{where}.variables.{k}")
    eps = raw.get("eps", config.default_eps)
    need(is_number(eps) and eps > 0, f"{where}.eps", "must be a number over 0")
    tree = lambda key: parse_tree(raw[key], f"{where}.{key}", key == "adaptive_eps_tree") if raw.get(key) is not None else None
    return Rule(float(eps), _weight(raw.get("template_weight", config.default_template_weight), f"{where}.template_weight"), parsed, tree("pairwise_tree"), tree("adaptive_eps_tree"))


def parse_config(raw: object) -> Config:
    need(isinstance(raw, dict), "config", "must be an object")
    _only(raw, TOP_KEYS, "config")
    eps = raw.get("default_eps", DEFAULT_EPS)
    need(is_number(eps) and eps > 0, "default_eps", "must be a number over 0")
    top = Config(float(eps), _weight(raw.get("default_template_weight", DEFAULT_TEMPLATE_WEIGHT), "default_template_weight"), _weight(raw.get("default_variable_weight", DEFAULT_VARIABLE_WEIGHT), "default_variable_weight"))
    rules = raw.get("rules", {})
    need(isinstance(rules, dict), "rules", "must be an object")
    return Config(top.default_eps, top.default_template_weight, top.default_variable_weight, {k: parse_rule(v, top, f"rules.{k}") for k, v in rules.items()})


def load_config(path: str, strict: bool = True, warn: Callable[[str], None] = lambda _: None) -> Config:
    """The configuration at ``path``; if not ``strict``, defaults and a warning for one that can't be used."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse_config(json.load(f))
    except (OSError, ValueError) as e:
        if strict:
            raise ConfigError(f"{path}: {e}") from e
        warn(f"{path} can't be used, defaults hold: {e}")
        return Config()


def config_at(path: str | None) -> Config:
    """The configuration at ``path``, which has to be usable, or the bundled one."""
    return load_config(path) if path else parse_config(BUNDLED)


def slot_plan(rule: Rule) -> list[Slot]:
    """The compared texts of a rule; what has no weight is left out, so it is never embedded."""
    plan = [Slot(-1, None, rule.template_weight, "embedding")] if rule.template_weight > 0 else []
    for k, v in sorted(rule.variables.items()):
        if v.level_weights is not None:
            plan += [Slot(k, (level,), w, v.match_mode) for level, w in v.level_weights if w > 0]
        elif v.weight > 0:
            plan.append(Slot(k, v.levels, v.weight, v.match_mode))
    return plan


def load_features(path: str | None = None) -> tuple[dict, ...]:
    if path is None:
        return DEFAULT_FEATURES
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    need(isinstance(raw, list) and raw, path, "must be a list with entries")
    return tuple(parse_feature(x, f"{path}[{k}]") for k, x in enumerate(raw))


@dataclass(frozen=True)
class Embeddings:
    backend: str = "local"
    base_url: str = ""
    model: str = "text-embedding-3-small"
    api_key: str | None = None
    batch_size: int = 512


def embeddings_path(given: str | None = None, environ: Mapping[str, str] | None = None) -> str | None:
    """The first of: the argument, the environment's variable, ``config.json`` here."""
    env = os.environ if environ is None else environ
    return given or (env.get("SIEVEWORK_EMBEDDINGS_CONFIG") or "").strip() or ("config.json" if os.path.exists("config.json") else None)


def load_embeddings(path: str | None, environ: Mapping[str, str] | None = None, warn: Callable[[str], None] = lambda _: None) -> Embeddings:
    """Lenient: what can't be used is warned about and replaced by its default."""
    env = os.environ if environ is None else environ
    raw: Any = {}
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        except (OSError, ValueError) as e:
            warn(f"{path} can't be read: {e}")
    if not isinstance(raw, dict):
        warn(f"{path} must hold an object")
        raw = {}
    text = lambda x: x.strip() if isinstance(x, str) else ""
    backend = text(raw.get("embeddings_backend")) or "local"
    if backend not in ("local", "openai_compatible"):
        warn(f"unknown backend {backend!r}; local is taken")
        backend = "local"
    size = raw.get("embed_batch_size", 512)
    if not is_int(size) or size < 1:
        warn(f"embed_batch_size {size!r} can't be used; 512 is taken")
        size = 512
    remote = raw.get("openai_compatible") if isinstance(raw.get("openai_compatible"), dict) else {}
    url = text(remote.get("base_url")).rstrip("/")
    if backend == "openai_compatible" and not url:
        warn("openai_compatible.base_url is missing; local is taken")
        backend = "local"
    if backend == "local":
        return Embeddings(batch_size=size)
    return Embeddings(backend, url, text(remote.get("model")) or "text-embedding-3-small", text(remote.get("api_key")) or text(env.get("OPENAI_API_KEY")) or None, size)
