"""Configuration checks, results files, and the commands."""

import json

import pytest

from sievework import cli
from sievework.operators import config as C
from sievework.sources import reports

GOOD = {"default_eps": 0.3, "rules": {"R": {"eps": 0.1, "template_weight": 0, "variables": {"0": {"levels": [-2]}, "1": {"level_weights": {"-3": 0.5}, "match_mode": "jaccard"}}}}}


def test_good_config():
    c = C.parse_config(GOOD)
    assert c.rule("R").variables[0].weight == 0.7 and c.rule("R").variables[1].level_weights == ((-3, 0.5),)
    assert (c.rule("other").eps, c.rule("other").template_weight) == (0.3, 0.3)


def test_bundled_config():
    c = C.config_at(None)
    assert c.rule("CGR_0018").eps == 0.04 and [s.variable for s in C.slot_plan(c.rule("CGR_0018"))] == [1]
    assert len(c.rule("DES_0001").adaptive_eps_tree.nodes) == 11 and c.rule("DES_0001").variables[0].levels == (-2,)


def rule(**entry):
    return {"rules": {"R": entry}}


def tree(**more):
    return {"features": [{"kind": "level_exact"}], "nodes": [{"value": 0}]} | more


BAD = [
    [], {"x": 1}, {"default_eps": 0}, {"default_eps": True}, {"default_template_weight": -1}, {"rules": []}, rule(x=1), rule(eps=-1), rule(variables=[]), rule(variables={"a": {}}),
    rule(variables={"0": {"x": 1}}), rule(variables={"0": {"weight": "1"}}), rule(variables={"0": {"levels": 1}}), rule(variables={"0": {"levels": [1], "level_weights": {"1": 1}}}),
    rule(variables={"0": {"level_weights": {"a": 1}}}), rule(variables={"0": {"level_weights": {}}}), rule(variables={"0": {"match_mode": "x"}}), rule(pairwise_tree=tree(features=[])), rule(pairwise_tree=tree(nodes=[])),
    rule(pairwise_tree=tree(nodes=[{"value": 2}])), rule(adaptive_eps_tree=tree(nodes=[{"value": 0}])), rule(adaptive_eps_tree=tree(nodes=[{"value": 0.12345}])), rule(pairwise_tree=tree(features=[{"kind": "x"}])),
    rule(pairwise_tree=tree(nodes=[{"feature": 0, "threshold": 0.5, "left": 0, "right": 0}])), rule(pairwise_tree=tree(nodes=[{"feature": 0, "threshold": 0.5, "left": 1, "right": 9}, {"value": 0}])),
    rule(pairwise_tree=tree(nodes=[{"feature": 3, "threshold": 0.5, "left": 1, "right": 1}, {"value": 0}])), rule(pairwise_tree=tree(nodes=[{"feature": 0, "threshold": 0.1234, "left": 1, "right": 1}, {"value": 0}])),
    rule(pairwise_tree=tree(nodes=[{"feature": 0, "threshold": 0.5, "left": 1}, {"value": 0}])), rule(pairwise_tree=tree(x=1)), rule(pairwise_tree=tree(features=[{"kind": "suffix_similarity", "decay": 0}])),
    rule(pairwise_tree=tree(features=[{"kind": "path_tfidf_char_wb", "ngram_range": [3]}])), rule(pairwise_tree=tree(features=[{"kind": "suffix_similarity", "max_shift": -1}])),
]


@pytest.mark.parametrize("raw", BAD)
def test_bad_config(raw):
    with pytest.raises(C.ConfigError):
        C.parse_config(raw)


def test_shared_nodes_are_fine():
    C.parse_config(rule(pairwise_tree=tree(nodes=[{"feature": 0, "threshold": 0.5, "left": 1, "right": 1}, {"value": 1}])))


def test_lenient_loading(tmp_path):
    told = []
    assert C.load_config(str(tmp_path / "none.json"), strict=False, warn=told.append) == C.Config() and told
    with pytest.raises(C.ConfigError):
        C.load_config(str(tmp_path / "none.json"))


def test_embeddings_config(tmp_path, monkeypatch):
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"embeddings_backend": "openai_compatible", "openai_compatible": {"base_url": "http://x/ "}, "embed_batch_size": 0}))
    told = []
    got = C.load_embeddings(str(p), {"OPENAI_API_KEY": "k"}, told.append)
    assert (got.backend, got.base_url, got.model, got.api_key, got.batch_size) == ("openai_compatible", "http://x", "text-embedding-3-small", "k", 512) and len(told) == 1
    p.write_text(json.dumps({"embeddings_backend": "openai_compatible"}))
    assert C.load_embeddings(str(p), {}, told.append).backend == "local"
    p.write_text("[")
    assert C.load_embeddings(str(p), {}, told.append) == C.Embeddings()
    monkeypatch.chdir(tmp_path)
    assert C.embeddings_path("a", {}) == "a" and C.embeddings_path(None, {"SIEVEWORK_EMBEDDINGS_CONFIG": "b"}) == "b" and C.embeddings_path(None, {}) is None
    (tmp_path / "config.json").write_text("{}")
    assert C.embeddings_path(None, {}) == "config.json"


REPORT = " error 1 0\n  CGR_0018 2 0 x\n  1 of 3  0  Clock 'u/a1' late\n  2 of 3  0  Clock 'u/a2' late\n  3 of 3  0  Clock 'u/b' late\n"


def test_commands(spark, tmp_path, capsys):
    report, logic, out, truth = (str(tmp_path / x) for x in ("r.rpt", "logic.json", "out.json", "truth.json"))
    (tmp_path / "r.rpt").write_text(REPORT)
    assert cli.run(["gca", report, "--ai", "off", "--out", logic], spark) == 0
    body = json.loads((tmp_path / "logic.json").read_text())
    assert body["schema_version"] == 2 and body["run"]["counts"] == {"parsed_logs": 3, "logic_groups": 2, "final_groups": 2} and "template_file" not in body["run"] and body["run"]["ai"]["backend"] is None
    assert [g["group_id"] for g in body["groups"]] == ["CGR_0018::logic::000001", "CGR_0018::logic::000002"] and body["groups"][0]["total_count"] == 2
    assert cli.run(["cluster", report, "--embedder", "hashing", "--out", out, "--max-original-logs", "2"], spark) == 0
    merged = json.loads((tmp_path / "out.json").read_text())["groups"]
    assert len(merged) == 1 and merged[0]["group_type"] == "ai_super" and len(merged[0]["original_logs"]) == 2
    assert cli.run(["cluster", report, "--embedder", "hashing", "--out", out], spark) == 0
    (tmp_path / "truth.json").write_text(json.dumps({"CGR_0018": [[g["group_id"] for g in body["groups"]]]}))
    assert cli.run(["gca-eval", truth, out, logic], spark) == 0
    (tmp_path / "truth.json").write_text(json.dumps({"CGR_0018": [[g["group_id"]] for g in body["groups"]]}))
    assert cli.run(["gca-eval", truth, out, logic], spark) == 1
    assert cli.run(["gca-distances", logic, "CGR_0018", "--embedder", "hashing", "--truth", truth], spark) == 0
    assert cli.run(["gca-distances", logic, "NONE_000", "--embedder", "hashing"], spark) == 1
    (tmp_path / "spec.json").write_text(json.dumps({"eps": [0.1], "variables": {"0": [{"weight": 1.0, "match_mode": "jaccard", "levels": [-1]}]}}))
    assert cli.run(["gca-fit-weights", logic, "CGR_0018", truth, "--embedder", "hashing", "--search-spec", str(tmp_path / "spec.json"), "--out", str(tmp_path / "w.json")], spark) == 0
    C.load_config(str(tmp_path / "w.json"))
    assert cli.run(["gca-fit-adaptive-eps", logic, "CGR_0018", truth, "--embedder", "hashing", "--max-depth", "2", "--max-min-samples-leaf", "2", "--out", str(tmp_path / "a.json")], spark) == 0
    assert C.load_config(str(tmp_path / "a.json")).rule("CGR_0018").adaptive_eps_tree
    capsys.readouterr()
    assert cli.run(["view", out, "--top", "1", "--no-color"], spark) == 0
    assert "Clock 'u/a1' late" in capsys.readouterr().out
    assert cli.run(["gca", str(tmp_path / "none.rpt"), "--ai", "off"], spark) == 1


def test_old_results_list(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps([{"rule_id": "R", "total_count": 3, "original_logs": ["a"]}]))
    described, groups = reports.read_results(spark, str(tmp_path / "old.json"))
    assert described is None and groups.first().total_count == 3
    for bad in ("3", '{"schema_version": 1}', '{"schema_version": 2, "groups": []}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            reports.read_results(spark, str(tmp_path / "bad.json"))
