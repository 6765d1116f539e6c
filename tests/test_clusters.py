"""Distances, components, trees, merged patterns, scores, levels, searches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import config as C
from sievework.operators import distance, embed, evaluate, features, levels, rollup, tuning
from sievework.operators.components import clusters, components
from sievework.plans import pipeline


def groups(spark, patterns, rule="R", template="t", counts=None):
    rows = [(rule, k, template if isinstance(template, str) else template[k], p, (counts or [1] * len(patterns))[k]) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "rule_id string, gid long, template string, pattern string, total_count long")


def axes(texts):
    """A unit axis for each distinct word: unlike texts are at distance 1."""
    names: dict[str, int] = {}
    out = []
    for t in texts:
        v = [0.0] * 64
        for w in t.split():
            v[names.setdefault(w, sum(map(ord, w)) % 64)] = 1.0
        out.append(v)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_random(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    assert [tuple(r) for r in clusters(spark.createDataFrame([(3,)], "node long"), none).collect()] == [(3, 3)]


def test_slot_plan():
    rule = C.Rule(0.2, 0.0, {0: C.Variable(0.7, None, ((-3, 0.5), (-2, 1.0))), 1: C.Variable(0.7), 2: C.Variable(0.0)})
    assert [(s.variable, s.levels, s.weight) for s in C.slot_plan(rule)] == [(0, (-3,), 0.5), (0, (-2,), 1.0), (1, None, 0.7)]


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_weighted_distance(spark, block):
    config = C.Config(rules={"R": C.Rule(0.5, 0.3, {0: C.Variable(0.7, match_mode="jaccard"), 1: C.Variable(0.5, match_mode="jaccard")})})
    own = groups(spark, ["block_a reg_1", "block_a reg_2", "block_a reg_1 / x"], template=["a b", "a b", "c"])
    got = {(r.i, r.j): r.dist for r in distance.pairs(distance.items(own, config, axes), block=block).collect()}
    cosine = 1.0
    assert got[0, 1] == pytest.approx(0.7 * (1 - 1 / 3) / 1.0)
    assert got[0, 2] == pytest.approx((0.3 * cosine + 0.7 * 0) / 1.0)  # the second slot isn't active in both
    assert got[1, 2] == pytest.approx(0.3 * cosine + 0.7 * (1 - 1 / 3))


def test_equal_texts_meet_once(spark, monkeypatch):
    """Groups with the same texts are one item, in clusters by the library and in those of the whole way."""
    met = []
    items = distance.items
    monkeypatch.setattr(distance, "items", lambda own, *more: (met.append(own.count()), items(own, *more))[1])
    texts = ["a", "a b", "c d", ""]
    own = groups(spark, [f"p{k % 2}" for k in range(400)], template=[texts[k % 3] for k in range(400)]).unionByName(groups(spark, ["x"] * 5, rule="S", template=texts[2]).withColumn("gid", F.col("gid") + 1000))
    expected = {k: k % 3 if k % 3 == 2 else 0 for k in range(400)} | {1000 + k: 1000 for k in range(5)}
    assert {r.gid: r.component for r in distance.template_clusters(own, axes, 0.3).collect()} == expected
    assert met == [4]
    config = C.Config(rules={"R": C.Rule(0.3, 1.0, {0: C.Variable(0.01, match_mode="jaccard")})}, default_template_weight=1.0)
    quoted = own.withColumn("pattern", F.concat(F.lit("'"), "pattern", F.lit("'")))
    assert {r.gid: r.component for r in pipeline.group_clusters(quoted, config, axes).collect()} == expected
    assert met == [4, 7]  # by template and pattern


def test_no_common_slot_merges(spark):
    config = C.Config(rules={"R": C.Rule(0.1, 0.0, {1: C.Variable(1.0, match_mode="jaccard")})})
    got = distance.pairs(distance.items(groups(spark, ["a", "b / c"]), config, axes)).collect()
    assert [r.dist for r in got] == [0.0]


def test_vector_blocks_agree(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(k % 2, k, rng.normal(size=8).tolist()) for k in range(40)], "key long, id long, vector array<double>")
    one, many = ({(r.i, r.j, r.dist) for r in distance.vector_pairs(v, 0.8, block=b).collect()} for b in (1000, 3))
    assert one == many and one


TREE = {"features": [{"kind": "level_exact", "levels": [-3]}], "nodes": [{"feature": 0, "threshold": 0.5, "left": 1, "right": 2}, {"value": 0.5}, {"value": 0.1}]}


def test_adaptive_scaling(spark):
    own = groups(spark, ["a/x/p/q", "b/x/p/q", "c/y/p/q"])
    base = spark.createDataFrame([("R", 0, 1, 0.2), ("R", 0, 2, 0.2)], "rule_id string, i long, j long, dist double")
    tree = C.parse_tree(TREE, "t", True)
    got = {(r.i, r.j): r.dist for r in features.adaptive_pairs(own, base, tree).collect()}
    assert got == {(0, 1): pytest.approx(2.0), (0, 2): pytest.approx(0.4)}


def test_pairs_of_blocks_are_all_pairs_once(spark):
    rows = spark.createDataFrame([("R", k, f"t{k}") for k in range(23)] + [("S", 50, "a"), ("S", 51, "b"), ("T", 60, "c")], "rule_id string, gid long, t string")
    expected = sorted([("R", i, j, f"t{i}", f"t{j}") for i in range(23) for j in range(i + 1, 23)] + [("S", 50, 51, "a", "b")])
    for block in (1000, 4):
        got = features.meeting(rows, block).select("rule_id", "i", "j", "i_t", "j_t").collect()
        assert sorted(map(tuple, got)) == expected


def test_tfidf_blocks_and_wanted_pairs(spark, monkeypatch):
    """Against dense vectors; ids of letters, documents without grams, and slabs of a few grams."""
    monkeypatch.setattr(features, "SLAB", 5)
    docs = [("R", f"g{k:02}", t) for k, t in enumerate(["ab cde", "abc cde", "xyz", "", "cdef ab ab", "AB  CDE"])] + [("S", "g00", "ab cde"), ("S", "g09", "ab")]

    def grams(t):
        out = []
        for w in t.lower().split():
            w = f" {w} "
            for n in range(3, 7):
                out += [w[k : k + n] for k in range(max(1, len(w) - n + 1))]
                if len(w) <= n:
                    break
        return out

    expected = {}
    for r in "RS":
        own = {g: grams(t) for rule, g, t in docs if rule == r}
        df = {x: sum(x in v for v in own.values()) for v in own.values() for x in v}
        vector = {g: {x: v.count(x) * (math.log((1 + len(own)) / (1 + df[x])) + 1) for x in v} for g, v in own.items()}
        length = {g: math.sqrt(sum(w * w for w in v.values())) or 1 for g, v in vector.items()}
        for i in own:
            for j in own:
                if i < j:
                    expected[r, i, j] = sum(w * vector[j].get(x, 0) for x, w in vector[i].items()) / length[i] / length[j]
    table = spark.createDataFrame(docs, "rule_id string, gid string, doc string")
    for block in (1000, 2):
        every = {(x.rule_id, x.i, x.j): x.f for x in features.similarities(table, 3, 6, "f", block=block).collect()}
        assert every == {k: pytest.approx(v, abs=1e-12) for k, v in expected.items()}
        some = spark.createDataFrame([(*k, 0.5) for k in list(expected)[::2]], "rule_id string, i string, j string, dist double")
        got = {(x.rule_id, x.i, x.j): (x.f, x.dist) for x in features.similarities(table, 3, 6, "f", some, block).collect()}
        assert got == {k: (pytest.approx(expected[k], abs=1e-12), 0.5) for k in list(expected)[::2]}


def test_joining_pairs_keep_components(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(i + 1, 20) if i % 3 == j % 3], "i long, j long").repartition(2)
    kept = distance.joining(pairs)
    assert kept.count() < 40
    parts = {r.component for r in components(kept.select(F.col("i").alias("a"), F.col("j").alias("b"))).collect()}
    assert parts == {0, 1, 2}


def test_bundled_adaptive_tree_end_to_end(spark):
    """Rule DES_0001 with the bundled configuration: groups merge exactly where distance and leaf of the pair say so."""
    config = C.parse_config(C.BUNDLED)
    paths = [f"top/u_core/u_bank{b}/u_dp/data_reg_{k}/q" for b in range(3) for k in "ab"] + ["chip/io_ring/pad_ctl/mode_latch/q", "chip/io_ring/pad_ctl/mode_latch/d"]
    own = spark.createDataFrame([("DES_0001", k, p, "Signal <VAR>", 1, k) for k, p in enumerate(paths)], "rule_id string, gid long, pattern string, template string, total_count long, first_seen long")
    tree = config.rules["DES_0001"].adaptive_eps_tree
    base = distance.pairs(distance.items(own, config, embed.hashing(16)))
    known = features.pair_features(own, tree.features, base).collect()
    assert len(known) == len(paths) * (len(paths) - 1) // 2

    def leaf(row, node=0):
        n = tree.nodes[node]
        return n["value"] if "value" in n else leaf(row, n["left"] if row[f"f{n['feature']}"] <= n["threshold"] else n["right"])

    top = list(range(len(paths)))
    for r in known:
        if r.dist / leaf(r) <= 1.0:
            a, b = sorted((top[r.i], top[r.j]))
            top = [a if x == b else x for x in top]
    got = {r.gid: r.component for r in pipeline.group_clusters(own, config, embed.hashing(16)).collect()}
    assert got == dict(enumerate(top)) and 1 < len(set(top)) < len(paths)


def test_suffix_similarity_brute(spark):
    def brute(a, b, s=3, decay=0.65):
        best = 0.0
        for shift in range(-s, s + 1):
            num = den = 0.0
            for off in range(max(len(a), len(b))):
                li, ri = len(a) - 1 - off, len(b) - 1 - (off + shift)
                if 0 <= li < len(a) and 0 <= ri < len(b):
                    x, y = set(a[li]), set(b[ri])
                    num += decay**off * (len(x & y) / len(x | y) if x | y else 1.0)
                    den += decay**off
            best = max(best, num / den if den else 0.0)
        return best

    rng = random.Random(5)
    rows = [tuple([[rng.choice("ABCD") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 5))] for _ in range(2)) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<array<string>>, b array<array<string>>").coalesce(1)
    got = [r[0] for r in df.select(features.suffix_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([brute(a, b) for a, b in rows])


def test_char_ngrams(spark):
    got = spark.createDataFrame([("Ab / cde",)], "d string").select(features.char_ngrams(F.col("d"), 3, 4)).first()[0]
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " / ", " cd", "cde", "de ", " cde", "cde "])


@pytest.mark.parametrize(
    ("patterns", "merged"),
    [
        (["'u_top/clk_gen_*' / 'master_*'", "'u_top/sig_out_*' / 'master_*'"], "'u_top/{clk_gen_*|sig_out_*}' / 'master_*'"), ([f"'seg_{k}'" for k in range(10)], "'*'"), (["a / b"], "a / b"),
        (["NO_VAR", "NO_VAR"], "NO_VAR"), (["NO_VAR", "a"], "a"), (["a/b", "c"], "{a/b|c}"), (["a/1", "a/2", "a/3", "a/4"], "a/{1|2|3|4}"), (["a/1", "a/2", "a/3", "a/4", "a/5"], "a/*"),
        (["'a'", '"b"'], "{a|b}"), (["'a'", "b"], "'{a|b}'"), (["a", "a / x"], "a / x"),
    ],
)
def test_merged_patterns(spark, patterns, merged):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(patterns)], "component long, ord long, pattern string")
    assert [tuple(r) for r in rollup.merged_patterns(df).collect()] == [(1, merged)]


def test_super_groups(spark):
    own = groups(spark, ["a", "b", "c"], template=["t0", "t1", "t2"], counts=[2, 5, 1])
    got = {r.component: r for r in rollup.super_groups(own, spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "gid long, component long")).collect()}
    assert (got[0].total_count, got[0].merged_variants_count, got[0].representative_template, got[0].representative_pattern) == (7, 2, "t1", "{a|b}")
    out = rollup.output_super_groups(rollup.super_groups(own, spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "gid long, component long"))).orderBy("seq").collect()
    assert [r.group_id for r in out] == ["R::ai::000001", "R::ai::000002"]


def test_pair_counts_brute(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, None]), rng.choice([0, 1, None])) for _ in range(40)]
    pairs = lambda c: {p for p in itertools.combinations(range(40), 2) if rows[p[0]][c] is not None and rows[p[0]][c] == rows[p[1]][c]}
    t, p = pairs(0), pairs(1)
    r = evaluate.pair_counts(spark.createDataFrame(rows, "truth int, predicted int")).first()
    assert (r.tp, r.fp, r.fn) == (len(t & p), len(p - t), len(t - p))


def test_evaluate(spark):
    logic = spark.createDataFrame([(0, "logic", "R", "g1", ["a"]), (1, "logic", "R", "g2", ["b"]), (2, "logic", "R", "g3", ["c"])], "pos int, group_type string, rule_id string, group_id string, original_logs array<string>")
    found = spark.createDataFrame([(0, "R", ["a", "b", "c", "unknown"])], "pos int, rule_id string, original_logs array<string>")
    truth = spark.createDataFrame([("R", 0, "g1"), ("R", 0, "g2"), ("R", 1, "g3")], "rule_id string, cluster long, group_id string")
    r = evaluate.evaluate(truth, found, logic).first()
    assert (r.tp, r.fp, r.fn, r.recall, r.passed) == (1, 2, 0, 1.0, False)
    alone = spark.createDataFrame([(0, "R", ["a"]), (1, "R", ["b"])], "pos int, rule_id string, original_logs array<string>")
    vacuous = truth.where("group_id = 'g1'")
    assert evaluate.evaluate(vacuous, alone.where("pos = 0"), logic).first().f1 == 1.0
    problems = evaluate.truth_problems(truth.where("group_id <> 'g3'").unionByName(spark.createDataFrame([("R", 5, "g1"), ("R", 5, "gx")], "rule_id string, cluster long, group_id string")), logic)
    assert {tuple(r) for r in problems.collect()} == {("duplicate", "g1"), ("missing", "g3"), ("unknown", "gx")}


def test_levels(spark):
    paths = spark.createDataFrame([(0, 0, "top/cpu/a/x/r1"), (0, 1, "top/cpu/a/x/r2"), (0, 2, "top/cpu/b/y/r3"), (0, 3, "top/cpu/b/y/r4")], "var int, gid long, path string")
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "gid long, cluster long")
    signals = levels.level_signals(paths, truth)
    assert [r.signal for r in signals.orderBy("level").collect()] == ["constant", "constant", "signal", "signal", "noise"]
    assert levels.recommendations(signals).first().recommendation == "take levels [-3, -2]; within labelled clusters [-1] differ"


def test_search_finds_the_level(spark):
    own = groups(spark, ["top/a/u1/p1", "top/a/u2/p1", "top/b/u3/p1", "top/b/u4/p1"])
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "gid long, cluster long")
    spec = {"template_weight": [0.0], "eps": [0.1], "variables": {"0": [{"weight": 1.0, "levels": [-2]}, {"weight": 1.0, "levels": [-3]}]}}
    entries = tuning.candidates(spec, {}, C.Rule(), 0.7)
    scored = tuning.score_candidates(own, truth, C.Config(), entries, axes)
    assert scored.count() == 2
    best = tuning.best(scored, 2).first()
    assert best.f1 == 1.0 and entries[best.candidate]["variables"]["0"]["levels"] == [-3]
    assert [r.candidate for r in tuning.best_first(scored, 2, 1).collect()] == [best.candidate]


def test_adaptive_fit_is_perfect_and_small(spark):
    own = groups(spark, ["top/a/x", "top/b/x", "top/c/y", "top/d/y"])
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "gid long, cluster long")
    specs = ({"kind": "level_exact", "levels": [-1]},)
    known = features.pair_features(own, specs).withColumn("dist", F.lit(0.3))
    tree, told = tuning.fit_adaptive(known, truth, specs, 3, 3)
    assert told["f1"] == 1.0 and len(tree.nodes) <= 3
    raw = tuning.with_adaptive_tree({"rules": {"R": {"pairwise_tree": {}}}}, "R", tree)
    assert raw["rules"]["R"]["eps"] == 1.0 and "pairwise_tree" not in raw["rules"]["R"]
    with pytest.raises(C.ConfigError):
        tuning.fit_adaptive(known, truth, specs, 3, 3, digits=4)


def test_default_search(spark):
    own = groups(spark, ["top/a/u1 / x"])
    spec = tuning.default_search(own, C.Config(), "R", size=2)
    tuning.check_search(spec)
    assert set(spec["variables"]) == {"0", "1"} and spec["eps"][0] == 0.2
    assert tuning.level_options(3, 2) == [[-3], [-2], [-1], [-3, -2], [-2, -1]]


def test_leaf_thresholds(spark):
    rows = [(0, 1, 0.1), (0, 0, 0.5), (1, 1, 0.3), (1, 0, 0.2), (1, 1, 0.1), (2, 0, 0.4), (3, 1, 0.25), (4, 1, 0.9), (4, 0, 0.2), (4, 0, 0.3)]
    got = {r.leaf: r.eps for r in evaluate.leaf_thresholds(spark.createDataFrame(rows, "leaf int, label int, dist double")).collect()}
    assert got == {0: 0.3, 1: 0.3, 2: 0.2, 3: 0.25, 4: 0.1}


def test_batches_and_retries():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise RuntimeError("503 busy")
        return [[1.0]] * len(texts)

    assert len(embed.persistent(flaky, list("abcde"), lambda _: None)) == 5
    assert calls == [5, 5, 5, 2, 3, 3, 3, 1, 2]
    with pytest.raises(embed.EmbeddingError):
        embed.persistent(lambda _: (_ for _ in ()).throw(ValueError("bad")), ["a"], lambda _: None)


def test_distinct_texts_are_embedded_once(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "text string")
    assert sorted(r.text for r in embed.embed_texts(df, embed.hashing(), 1).collect()) == ["a", "b"]


@pytest.mark.parametrize("payload", [{}, {"data": [{"index": 0}]}, {"data": [{"index": 0, "embedding": ["x"]}]}, {"data": [{"index": 0, "embedding": [1]}]}, []])
def test_bad_responses(payload):
    with pytest.raises(embed.EmbeddingError):
        embed.parse_response(payload, 2)


def test_response_order():
    assert embed.parse_response({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1.0], [2.0]]


def test_pipeline_modes(spark):
    rows = [("f", k, "error", "R", [v], "t '<VAR>'", f"t '{v}'") for k, v in enumerate(["u_top/a", "u_top/a", "u_top/b"])] + [("f", 9, "error", "S", ["z"], "s '<VAR>'", "s 'z'")]
    records = spark.createDataFrame(rows, "file string, line_no long, severity string, rule_id string, variables array<string>, template string, raw_log string")
    off, used = pipeline.run(records, ai="off")
    assert not used and {r.group_type for r in off.collect()} == {"logic"}
    out, used = pipeline.run(records, None, embed.hashing())  # equal templates merge
    got = {r.rule_id: r for r in out.collect()}
    assert used and got["R"].representative_pattern == "u_top/{a|b}" and got["R"].total_count == 3 and len(got["R"].original_logs) == 3

    def broken(_):
        raise RuntimeError("no model")

    told = []
    alone, used = pipeline.run(records, None, broken, warn=told.append)
    assert used and alone.count() == 3 and told
    with pytest.raises(RuntimeError):
        pipeline.run(records, None, broken, "on")
