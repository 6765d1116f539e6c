"""The engine's operators as queries over the relational tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import distance, embed, evaluate, features, levels, logic, parse, rollup, tuning
from sievework.operators.components import clusters
from sievework.operators.config import Config, Rule, Tree, Variable
from sievework.plans import pipeline
from sievework.storage import store

EPS = 0.75
#: Report lines made from events, in SQL that both engines run.
LINES = """
SELECT event_id AS line_no, replace(
 CASE WHEN event_id % 600 = 0   THEN ' error                  62   0'
      WHEN event_id % 600 = 200 THEN ' Warning                12   0'
      WHEN event_id % 600 = 400 THEN ' info                    3   0'
      WHEN event_id % 20 = 1 THEN concat('  ', upper(substr(event_type,1,3)), '_', lpad(cast(user_id % 5 AS string),4,'0'), '          46    0 Clock ~clk1~ is generated from ~clk2~')
      WHEN event_id % 97 = 5 THEN 'Scenario: slow'
      WHEN event_id % 61 = 7 THEN '-----------'
      WHEN event_id % 53 = 9 THEN ''
      WHEN event_id % 41 = 3 THEN concat('       ', cast(event_id % 20 AS string), ' of 20   0    No clocks defined ', cast(user_id AS string))
      ELSE concat('       ', cast(event_id % 20 AS string), ' of 20          0    Path ~top/u_', event_type, '/blk_', cast(user_id % 4 AS string), '/reg_', cast(user_id AS string), '/CK~ hits ~clk_', cast(user_id % 7 AS string), '~ with ', cast(event_id % 13 AS string), ' retries')
 END, '~', chr(39)) AS value FROM events
"""
KINDS = rf"""l AS ({LINES}),
k AS (SELECT *, CASE WHEN trim(value) = '' OR regexp_matches(value, '^\s*[*=\-]+\s*$') THEN 'skip'
  WHEN regexp_matches(value, '^\s*(error|warning|info)\s+\d+\s+\d+\s*$', 'i') THEN 'severity'
  WHEN regexp_matches(value, '^\s{{0,6}}([A-Z]{{2,4}}_\d{{3,4}})\s+\d+(?:\s+\d+(?:\s+\S.*)?)?\s*$') THEN 'rule'
  WHEN regexp_matches(value, '^\s*(\d+)\s+of\s+(\d+)\s+(\d+)\s+(.*\S)') THEN 'instance' ELSE 'noise' END AS kind FROM l)"""
CONTEXT = (
    KINDS
    + r""",
c AS (SELECT *, last_value(CASE WHEN kind = 'severity' THEN lower(regexp_extract(value, '^\s*(\w+)', 1)) END IGNORE NULLS) OVER w AS severity,
  nullif(last_value(CASE WHEN kind IN ('severity', 'noise') THEN '' WHEN kind = 'rule' THEN regexp_extract(value, '^\s*(\S+)', 1) END IGNORE NULLS) OVER w, '') AS rule_id
  FROM k WINDOW w AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)
RECORDS = (
    CONTEXT
    + r""",
i AS (SELECT *, regexp_extract(value, '^\s*(\d+)\s+of\s+(\d+)\s+(\d+)\s+(.*\S)', 4) AS raw_log FROM c WHERE kind = 'instance' AND rule_id IS NOT NULL AND severity IS NOT NULL),
r AS (SELECT *, regexp_extract_all(raw_log, '''(.*?)''', 1) AS found, trim(regexp_replace(regexp_replace(raw_log, '''(.*?)''', '''<VAR>''', 'g'), '\b\d+\b', '<NUM>', 'g')) AS template FROM i),
p AS (SELECT *, CASE WHEN len(found) = 0 THEN ['NO_VAR'] ELSE found END AS variables FROM r),
g AS (SELECT rule_id, array_to_string(list_transform(variables, lambda x: regexp_replace(x, '\d+', '*', 'g')), ' / ') AS pattern, template, count(*) AS total_count, min(line_no) AS first_seen FROM p GROUP BY 1, 2, 3)"""
)
TOKENS = r"""list_filter(list_transform(string_split(path, '/'), lambda s: list_filter(list_transform(string_split(regexp_replace(regexp_replace(split_part(upper(trim(s)), '__MBIT_', 1), '\d+', '*', 'g'), '[^A-Z0-9*]+', '_', 'g'), '_'), lambda t: trim(t, '*')), lambda t: len(t) > 1 AND NOT list_contains(string_split('%s', ' '), t))), lambda s: len(s) > 0)""" % " ".join(T.GENERIC_TOKENS)


def _reach(pairs: str, nodes: str, key: str = "") -> str:
    """Components over ``pairs`` (``i``, ``j``) of ``nodes`` (``id``), as a CTE ``comp`` (``id``, ``component``)."""
    k = f"{key}, " if key else ""
    on = f"e.{key} = w.{key} AND " if key else ""
    return f"""ends AS (SELECT {k}i AS a, j AS b FROM {pairs} UNION ALL SELECT {k}j, i FROM {pairs}),
walk({k}id, seen) AS (SELECT {k}id, id FROM {nodes} UNION SELECT {"w." + key + ", " if key else ""}w.id, e.b FROM walk w JOIN ends e ON {on}e.a = w.seen),
comp AS (SELECT {k}id, min(seen) AS component FROM walk GROUP BY {k}id)"""


COSINE = f"""cp AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(1 - greatest(-1.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS dist
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), near AS (SELECT * FROM cp WHERE dist <= {EPS}), vs AS (SELECT vec_id AS id FROM embeddings)"""


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    return spark.sql(LINES.replace("FROM events", "FROM {events}"), events=events).select(F.lit("events").alias("file"), "line_no", "value")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.records(lines(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logic.logic_groups(records(spark, sf_dir))


def line_kinds(spark, sf_dir):
    return parse.classified(lines(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def parsed_records(spark, sf_dir):
    return records(spark, sf_dir).select("line_no", "severity", "rule_id", F.array_join("variables", "|").alias("variables"), "template", "raw_log")


def run_counters(spark, sf_dir):
    return parse.run_counters(lines(spark, sf_dir))


def severity_rollup(spark, sf_dir):
    return records(spark, sf_dir).groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def logic_groups_ranked(spark, sf_dir):
    return logic.output_groups(groups(spark, sf_dir)).drop("original_logs").withColumn("seq", F.col("seq").cast("long"))


def top_groups(spark, sf_dir):
    return logic.ranked_groups(groups(spark, sf_dir)).orderBy("seq").limit(10).select(F.col("seq").cast("long").alias("seq"), "rule_id", "pattern", "template", "total_count")


def original_logs_capped(spark, sf_dir):
    return logic.original_logs(records(spark, sf_dir), 2).select("rule_id", "pattern", "template", F.array_join("original_logs", "|").alias("logs"))


def _supplier_messages(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier", "s_name", "s_nationkey", "s_suppkey"), read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    text = F.concat(F.lit("Supplier '"), "s_name", F.lit("' of '"), "n_name", F.lit("' has "), F.col("s_suppkey").cast("string"), F.lit(" lines in "), "n_name")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", text.alias("message"))


def supplier_templates(spark, sf_dir):
    return _supplier_messages(spark, sf_dir).select("s_suppkey", T.template(F.col("message")).alias("template"), T.mask_numbers(F.col("message")).alias("masked"))


def unknown_rule_id(spark, sf_dir):
    named = _supplier_messages(spark, sf_dir).select(T.template(F.col("message")).alias("template"))
    return named.groupBy("template").agg(F.count(F.lit(1)).alias("n")).select("template", T.unknown_rule(F.col("template")).alias("rule_id"), "n")


def _entries(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    text = F.concat(F.lit("Part '"), "p_brand", F.lit("' size "), F.col("p_size").cast("string"), F.lit(" type "), "p_type")
    shared = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.lit("ALL")).otherwise(F.col("p_brand"))
    return p.select(F.concat(F.lit("R_"), F.substring("p_type", 1, 3), F.lit("_"), shared).alias("rule_id"), text.alias("message"), F.col("p_partkey").alias("line_no"))


def legacy_rule_lookup(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber"), read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    text = F.concat(F.lit("Part '"), "p_brand", F.lit("' size "), F.col("l_linenumber").cast("string"), F.lit(" type "), "p_type")
    logs = l.join(p, l["l_partkey"] == p["p_partkey"]).select(text.alias("raw_log"))
    return parse.resolve_rules(logs, _entries(spark, sf_dir)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def ambiguous_templates(spark, sf_dir):
    return parse.ambiguous_templates(_entries(spark, sf_dir))


def slot_split(spark, sf_dir):
    cut = groups(spark, sf_dir).select("total_count", F.posexplode(T.slots(F.col("pattern"))).alias("slot", "text"))
    return cut.groupBy("slot", "text").agg(F.sum("total_count").alias("n"))


def select_levels(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.select_levels(F.col("url"), [-3, -1, 9]).alias("chosen"), T.select_levels(F.col("url"), None).alias("whole"))


def _paths(spark, sf_dir):
    return groups(spark, sf_dir).select("rule_id", T.primary_path(F.col("pattern")).alias("path")).distinct()


def path_documents(spark, sf_dir):
    return _paths(spark, sf_dir).select("rule_id", "path", T.path_document(F.col("path")).alias("doc"), F.size(T.segment_tokens(F.col("path"))).cast("long").alias("segments"))


def path_depth_stats(spark, sf_dir):
    deep = read(spark, sf_dir, "pages", "url").select(F.size(T.path_parts(F.col("url"))).cast("long").alias("depth"))
    return deep.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def _named_parts(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_brand", "p_name").distinct()


def jaccard_pairs(spark, sf_dir):
    p = _named_parts(spark, sf_dir).withColumn("words", T.bare_token_set(F.col("p_name")))
    a, b = p.select("p_brand", F.col("p_name").alias("a"), F.col("words").alias("wa")), p.select("p_brand", F.col("p_name").alias("b"), F.col("words").alias("wb"))
    return a.join(b, "p_brand").where("a < b").select("p_brand", "a", "b", F.round(T.jaccard_distance(F.col("wa"), F.col("wb")), 6).alias("dist"))


def _vectors(spark, sf_dir, key="label"):
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.expr(key).cast("long").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def cosine_pairs(spark, sf_dir):
    return distance.vector_pairs(_vectors(spark, sf_dir), EPS).select(F.col("key").cast("int").alias("label"), "i", "j", "dist")


def _vector_clusters(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings", "vec_id", "label")
    near = distance.vector_pairs(_vectors(spark, sf_dir), EPS, links_only=True)
    joined = clusters(v.select(F.col("vec_id").alias("node")), near.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return v.join(joined.withColumnRenamed("node", "vec_id"), "vec_id")


def cosine_components(spark, sf_dir):
    return _vector_clusters(spark, sf_dir).select("vec_id", "component")


def component_rollup(spark, sf_dir):
    """Super groups of vector clusters, in the order and with the names of the results."""
    placed = _vector_clusters(spark, sf_dir).withColumn("gid", F.col("vec_id"))
    made = {"rule_id": F.concat(F.lit("R"), "label"), "template": F.concat(F.lit("t"), F.col("gid") % 5), "pattern": F.concat(F.lit("'v"), F.col("gid") % 3, F.lit("'")), "total_count": F.col("gid") % 7 + 1}
    own = store(placed.withColumns(made), "placed-groups")
    supers = rollup.super_groups(own.select("rule_id", "gid", "template", "pattern", "total_count"), own.select("gid", "component"))
    return rollup.output_super_groups(supers).select("group_type", "group_id", "rule_id", "representative_template", "total_count", "merged_variants_count", F.col("seq").cast("long").alias("seq"))


def by_first_letter(texts):
    """An embedder for which texts are near if they begin alike."""
    return [[float(ord(t[:1] or " ") % 32 == k) for k in range(32)] for t in texts]


def template_only_clusters(spark, sf_dir):
    """Clusters of parts by the vectors of their types alone."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select(F.col("p_brand").alias("rule_id"), F.col("p_partkey").cast("long").alias("gid"), F.col("p_type").alias("template"), F.lit("'x'").alias("pattern"))
    return distance.template_clusters(parts, by_first_letter).select("rule_id", "gid", "component")


def _part_items(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_type", "p_size").withColumn("big", F.col("p_size") > 10)
    one = p.groupBy("p_brand", "p_name", "p_type", "big").agg(F.min("p_partkey").alias("gid"))
    made = lambda k, text, active, w: F.struct(F.lit(k).alias("slot"), F.col(text).alias("text"), active.alias("active"), F.lit(w).alias("weight"), F.lit("jaccard").alias("mode"), F.lit(None).cast("array<double>").alias("vector"))
    return one.select(F.col("p_brand").alias("rule_id"), "gid", F.array(made(0, "p_name", F.lit(True), 0.3), made(1, "p_type", F.col("big"), 0.7)).alias("slots"))


def weighted_distance(spark, sf_dir):
    packed = store(_part_items(spark, sf_dir), "part-items")
    eps = packed.select("rule_id").distinct().withColumn("eps", F.lit(0.21))
    return distance.pairs(packed, eps).select(F.col("rule_id").alias("p_brand"), "i", "j", F.round("dist", 6).alias("dist"))


def merged_patterns(spark, sf_dir):
    own = groups(spark, sf_dir).withColumn("component", F.xxhash64("rule_id"))
    names = own.select("component", "rule_id").distinct()
    merged = rollup.merged_patterns(own.select("component", F.col("first_seen").alias("ord"), "pattern"))
    return merged.join(names, "component").select("rule_id", "merged")


PART_TREE = Tree(
    ({"kind": "level_exact", "levels": [1]}, {"kind": "level_jaccard", "levels": [-1]}, {"kind": "path_length_equal"}, {"kind": "path_length_diff"}),
    ({"feature": 0, "threshold": 0.5, "left": 1, "right": 2}, {"value": 1}, {"feature": 1, "threshold": 0.3, "left": 3, "right": 4}, {"value": 1}, {"feature": 2, "threshold": 0.5, "left": 5, "right": 6}, {"value": 1}, {"value": 0}),
)
SCALE_TREE = Tree(PART_TREE.features, ({"feature": 1, "threshold": 0.3, "left": 1, "right": 2}, {"value": 0.4}, {"feature": 3, "threshold": 0.5, "left": 3, "right": 4}, {"value": 0.7}, {"value": 0.1}))


def _part_groups(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    one = p.groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("gid"))
    return store(one.select(F.col("p_brand").alias("rule_id"), "gid", F.concat_ws("/", "p_brand", "p_type", "p_name").alias("pattern")), "part-groups")


def pairwise_tree(spark, sf_dir):
    found = features.tree_pairs(_part_groups(spark, sf_dir), PART_TREE)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("dist") == 0).alias("merged"), F.sum(F.when(F.col("dist") == 0, F.col("i") + F.col("j")).otherwise(0)).alias("ids"))


def adaptive_eps(spark, sf_dir):
    own = _part_groups(spark, sf_dir)
    words = own.withColumn("words", T.bare_token_set(F.element_at(F.split("pattern", "/"), -1)))
    base = features.meeting(words.select("rule_id", "gid", "words")).select("rule_id", "i", "j", T.jaccard_distance(F.col("i_words"), F.col("j_words")).alias("dist"))
    scaled = features.adaptive_pairs(own, base, SCALE_TREE)
    return scaled.groupBy("rule_id").agg(F.count_if(F.col("dist") <= 1.0).alias("merged"), F.round(F.sum("dist"), 4).alias("total"))


def suffix_similarity(spark, sf_dir):
    s = _paths(spark, sf_dir).select("rule_id", "path", T.segment_tokens(F.col("path")).alias("s"))
    a, b = s.select("rule_id", F.col("path").alias("a"), F.col("s").alias("sa")), s.select("rule_id", F.col("path").alias("b"), F.col("s").alias("sb"))
    return a.join(b, "rule_id").where("a < b").select("rule_id", "a", "b", F.round(features.suffix_similarity(F.col("sa"), F.col("sb")), 6).alias("similarity"))


def tfidf_char_wb(spark, sf_dir):
    docs = _named_parts(spark, sf_dir).select(F.col("p_brand").alias("rule_id"), F.col("p_name").alias("gid"), F.col("p_name").alias("doc"))
    return features.tfidf_similarity(docs).select(F.col("rule_id").alias("p_brand"), F.col("i").alias("a"), F.col("j").alias("b"), F.round("similarity", 6).alias("similarity"))


def pair_f1(spark, sf_dir):
    rows = _vector_clusters(spark, sf_dir).select(F.col("label").alias("truth"), F.col("component").alias("predicted"))
    return evaluate.scores(evaluate.pair_counts(rows)).select("tp", "fp", "fn", "precision", "recall", "f1", "passed")


def gt_completeness(spark, sf_dir):
    known = read(spark, sf_dir, "documents", "doc_id").select(F.lit("logic").alias("group_type"), F.col("doc_id").cast("string").alias("group_id"))
    truth = read(spark, sf_dir, "labels", "doc_id").select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 7, 10_000_000).otherwise(0)).cast("string").alias("group_id"))
    return evaluate.truth_problems(truth, known)


def level_signal_noise(spark, sf_dir):
    paths = records(spark, sf_dir).select(F.lit(0).alias("var"), F.col("line_no").alias("gid"), F.get("variables", F.lit(0)).alias("path"))
    truth = read(spark, sf_dir, "events", "event_id", "event_type").select(F.col("event_id").alias("gid"), F.col("event_type").alias("cluster"))
    found = levels.level_signals(paths.where("path <> 'NO_VAR'"), truth)
    return found.select(*(F.col(c).cast("long").alias(c) for c in ("var", "depth", "level", "n_unique")), "signal")


def level_recommendation(spark, sf_dir):
    paths = records(spark, sf_dir).select(F.lit(0).alias("var"), F.col("line_no").alias("gid"), F.get("variables", F.lit(0)).alias("path"))
    truth = read(spark, sf_dir, "events", "event_id", "event_type").select(F.col("event_id").alias("gid"), F.col("event_type").alias("cluster"))
    return levels.recommendations(levels.level_signals(paths.where("path <> 'NO_VAR'"), truth))


def leaf_eps(spark, sf_dir):
    known = distance.vector_pairs(_vectors(spark, sf_dir, "label div 2"), 2.0)
    label = read(spark, sf_dir, "embeddings", "vec_id", "label")
    side = lambda c: label.select(F.col("vec_id").alias(c), F.col("label").alias(f"l{c}"))
    told = known.join(side("i"), "i").join(side("j"), "j").select(((F.col("i") + F.col("j")) % 4).alias("leaf"), (F.col("li") == F.col("lj")).cast("int").alias("label"), "dist")
    return evaluate.leaf_thresholds(told)


def grid_search_topk(spark, sf_dir):
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("candidate"), F.lit(eps).alias("eps")) for k, eps in enumerate((0.6, 0.7, 0.75, 0.8, 0.85)))))
    near = distance.vector_pairs(_vectors(spark, sf_dir), 0.85).select("i", "j", "dist", grid.alias("g")).select("i", "j", "dist", "g.*").where("dist <= eps")
    v = read(spark, sf_dir, "embeddings", "vec_id", "label").select("vec_id", "label", grid.alias("g")).select("vec_id", "label", "g.*").withColumn("node", F.col("candidate") * tuning.SPAN + F.col("vec_id"))
    at = lambda c: F.col("candidate") * tuning.SPAN + F.col(c)
    joined = clusters(v.select("node"), near.select(at("i").alias("a"), at("j").alias("b")))
    rows = v.join(joined, "node").select("eps", F.col("label").alias("truth"), F.col("component").alias("predicted"))
    scored = evaluate.scores(evaluate.pair_counts(rows, "eps"), 6)
    return scored.orderBy(F.desc("f1"), F.desc("precision"), "eps").limit(3).select("eps", "tp", "fp", "fn", "precision", "recall", "f1")


def distance_report(spark, sf_dir):
    known = distance.vector_pairs(_vectors(spark, sf_dir), 0.9).select("i", "j", "dist")
    truth = read(spark, sf_dir, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("gid"), F.col("label").alias("cluster"))
    return evaluate.annotated_pairs(known, truth, EPS)


def text_sizes(texts):
    """An embedder whose vectors are told by the text."""
    return [[float(len(t)), 1.0] for t in texts]


def distinct_texts(spark, sf_dir):
    """Each distinct text is embedded once, and its rows get its vector."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "text").where("text is not null")
    placed = embed.with_vectors(rows, embed.embed_texts(rows, text_sizes, 64))
    told = placed.groupBy("text").agg(F.count(F.lit(1)).alias("placed"), F.max(F.get("vector", F.lit(0))).alias("first"))
    return embed.distinct_texts(rows).join(told, "text").select(F.md5("text").alias("text_md5"), "uses", "placed", "first")


CONFIG = Config(rules={"CLI_0001": Rule(0.04, 0.0, {0: Variable(0.7, (-3,)), 1: Variable(1.0)}), "VIE_0002": Rule(0.5, 0.2, {0: Variable(0.7, match_mode="jaccard")})})


def super_groups(spark, sf_dir):
    """The flagship with its second stage, on hashed vectors: no SQL has those."""
    out, _ = pipeline.run(records(spark, sf_dir), CONFIG, embed.hashing(), most_logs=3)
    return out


def weight_search(spark, sf_dir):
    """A search over one rule's configurations, on hashed vectors."""
    own = store(pipeline.numbered(groups(spark, sf_dir)).where("rule_id = 'CLI_0001'"), "rule")
    truth = own.select("gid", T.select_levels(T.primary_path(F.col("pattern")), [1]).alias("cluster"))
    spec = {"template_weight": [0.0], "eps": [0.05, 0.2], "variables": {"0": [{"weight": 1.0, "match_mode": "jaccard", "levels": [-4]}, {"weight": 1.0, "match_mode": "jaccard"}]}}
    entries = tuning.candidates(spec, {}, Rule(), 0.7)
    return tuning.best_first(tuning.score_candidates(own, truth, Config(), entries, embed.hashing()), 5)


def adaptive_fit(spark, sf_dir):
    """The best adaptive tree for one brand's parts, clusters being types."""
    own = _part_groups(spark, sf_dir).where("rule_id = 'Brand#1'")
    truth = own.select("gid", F.element_at(F.split("pattern", "/"), 2).alias("cluster"))
    specs = ({"kind": "level_exact", "levels": [1]}, {"kind": "path_length_diff"})
    known = features.pair_features(own, specs).withColumn("dist", F.when(F.col("f0") == 1, F.lit(0.2)).otherwise(F.lit(0.6)))
    tree, told = tuning.fit_adaptive(known, truth, specs, 2, 3)
    return spark.createDataFrame([(told["f1"], len(tree.nodes))], "f1 double, nodes int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_kinds, parsed_records, run_counters, severity_rollup, logic_groups_ranked, top_groups, original_logs_capped, supplier_templates, unknown_rule_id, legacy_rule_lookup, ambiguous_templates,
        slot_split, select_levels, path_documents, path_depth_stats, jaccard_pairs, cosine_pairs, cosine_components, component_rollup, template_only_clusters, weighted_distance, merged_patterns,
        pairwise_tree, adaptive_eps, suffix_similarity, tfidf_char_wb, pair_f1, gt_completeness, level_signal_noise, level_recommendation, leaf_eps, grid_search_topk, distance_report, distinct_texts,
        super_groups, weight_search, adaptive_fit,
    )
} | {"logic_groups": groups}

PARTS = "p AS (SELECT p_brand AS rule_id, p_type, p_name, min(p_partkey) AS gid FROM part GROUP BY 1, 2, 3), q AS (SELECT a.rule_id, a.gid AS i, b.gid AS j, (a.p_type = b.p_type)::DOUBLE AS f0, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) AS f1 FROM p a JOIN p b ON a.rule_id = b.rule_id AND a.gid < b.gid)"
SUPPLIERS = "m AS (SELECT s_suppkey, concat('Supplier ''', s_name, ''' of ''', n_name, ''' has ', s_suppkey, ' lines in ', n_name) AS message FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT *, trim(regexp_replace(regexp_replace(message, '''(.*?)''', '''<VAR>''', 'g'), '\\b\\d+\\b', '<NUM>', 'g')) AS template FROM m)".replace("\\\\", "\\")
TEMPLATE = r"trim(regexp_replace(regexp_replace({0}, '''(.*?)''', '''<VAR>''', 'g'), '\b\d+\b', '<NUM>', 'g'))"
ENTRIES = "e AS (SELECT concat('R_', substr(p_type, 1, 3), '_', CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'ALL' ELSE p_brand END) AS rule_id, concat('Part ''', p_brand, ''' size ', p_size, ' type ', p_type) AS message, p_partkey AS line_no FROM part)"
JACCARD = "len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' '))))"
F1 = "CASE WHEN tp + {0} = 0 THEN 1.0 ELSE tp / (tp + {0}) END"


def _scored(counts: str, keys: str = "", digits: int = 4) -> str:
    k = f"{keys}, " if keys else ""
    return f"""pr AS (SELECT *, {F1.format("fp")} AS p_, {F1.format("fn")} AS r_ FROM {counts}), sc AS (SELECT *, CASE WHEN p_ + r_ = 0 THEN 0.0 ELSE 2 * p_ * r_ / (p_ + r_) END AS f_ FROM pr),
out AS (SELECT {k}tp, fp, fn, round(p_, {digits})::DOUBLE AS precision, round(r_, {digits})::DOUBLE AS recall, round(f_, {digits})::DOUBLE AS f1, f_ >= 0.97 AS passed FROM sc)"""


def _counted(rows: str, key: str = "") -> str:
    """``tp``, ``fp``, ``fn`` of ``rows`` (``truth``, ``predicted``) as the CTE ``counted``."""
    by = lambda c: f"SELECT {key + ', ' if key else ''}sum(n * (n - 1) // 2)::BIGINT AS n FROM (SELECT {key + ', ' if key else ''}count(*) AS n FROM {rows} GROUP BY {key + ', ' if key else ''}{c}) {'GROUP BY ' + key if key else ''}"
    on = f"USING ({key})" if key else "ON true"
    head = f"a.{key}, " if key else ""
    return f"""ta AS ({by("truth, predicted")}), tb AS ({by("predicted")}), tc AS ({by("truth")}),
counted AS (SELECT {head}a.n AS tp, b.n - a.n AS fp, c.n - a.n AS fn FROM ta a JOIN tb b {on} JOIN tc c {on})"""


ORACLES: dict[str, str] = {
    "line_kinds": f"WITH {KINDS} SELECT kind, count(*) AS n FROM k GROUP BY 1",
    "parsed_records": f"WITH {RECORDS} SELECT line_no, severity, rule_id, array_to_string(variables, '|') AS variables, template, raw_log FROM p",
    "run_counters": f"WITH {CONTEXT}, z AS (SELECT *, kind = 'instance' AND rule_id IS NOT NULL AND severity IS NOT NULL AS kept FROM c) SELECT count(*) FILTER (kept) AS instances, count(*) FILTER (kind = 'severity') AS severities, count(*) FILTER (kind = 'rule') AS rules, count(*) FILTER (NOT kept AND kind NOT IN ('severity', 'rule')) AS skipped FROM z",
    "severity_rollup": f"WITH {RECORDS} SELECT severity, rule_id, count(*) AS n FROM p GROUP BY 1, 2",
    "logic_groups": f"WITH {RECORDS} SELECT * FROM g",
    "logic_groups_ranked": f"WITH {RECORDS}, z AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, first_seen) AS seq FROM g) SELECT 'logic' AS group_type, printf('%s::logic::%06d', rule_id, seq) AS group_id, rule_id, template AS representative_template, pattern AS representative_pattern, total_count, 1::BIGINT AS merged_variants_count, seq FROM z",
    "top_groups": f"WITH {RECORDS}, z AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, first_seen) AS seq FROM g) SELECT seq, rule_id, pattern, template, total_count FROM z WHERE seq <= 10",
    "original_logs_capped": f"WITH {RECORDS}, m AS (SELECT *, array_to_string(list_transform(variables, lambda x: regexp_replace(x, '\\d+', '*', 'g')), ' / ') AS pattern FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY rule_id, pattern, template ORDER BY line_no) AS place FROM m) SELECT rule_id, pattern, template, string_agg(raw_log, '|' ORDER BY line_no) AS logs FROM z WHERE place <= 2 GROUP BY 1, 2, 3",
    "supplier_templates": rf"WITH {SUPPLIERS} SELECT s_suppkey, template, regexp_replace(message, '\b\d+\b', '<NUM>', 'g') AS masked FROM t",
    "unknown_rule_id": f"WITH {SUPPLIERS} SELECT template, 'UNKNOWN_' || upper(substr(md5(template), 1, 6)) AS rule_id, count(*) AS n FROM t GROUP BY 1, 2",
    "legacy_rule_lookup": f"""WITH {ENTRIES}, x AS (SELECT trim(message) AS message, max_by(rule_id, line_no) AS exact FROM e GROUP BY 1), y AS (SELECT {TEMPLATE.format("message")} AS template, min(rule_id) AS by_template FROM e GROUP BY 1 HAVING count(DISTINCT rule_id) = 1),
      l AS (SELECT concat('Part ''', p_brand, ''' size ', l_linenumber, ' type ', p_type) AS raw_log FROM lineitem JOIN part ON l_partkey = p_partkey), z AS (SELECT *, {TEMPLATE.format("raw_log")} AS template FROM l)
      SELECT coalesce(exact, by_template, 'UNKNOWN_' || upper(substr(md5(z.template), 1, 6))) AS rule_id, count(*) AS n FROM z LEFT JOIN x ON trim(raw_log) = x.message LEFT JOIN y ON z.template = y.template GROUP BY 1""",
    "ambiguous_templates": f"WITH {ENTRIES} SELECT {TEMPLATE.format('message')} AS template, count(DISTINCT rule_id) AS rules FROM e GROUP BY 1 HAVING count(DISTINCT rule_id) > 1",
    "slot_split": rf"WITH {RECORDS}, s AS (SELECT total_count, regexp_split_to_array(trim(pattern), '\s+/\s+') AS a FROM g), u AS (SELECT total_count, unnest(range(len(a)))::INT AS slot, unnest(a) AS text FROM s) SELECT slot, text, sum(total_count)::BIGINT AS n FROM u GROUP BY 1, 2",
    "select_levels": "WITH s AS (SELECT page_id, list_transform(string_split(url, '/'), lambda x: trim(x)) AS a FROM pages) SELECT page_id, array_to_string(list_filter([a[-3], a[-1], a[10]], lambda x: x IS NOT NULL), ' ') AS chosen, array_to_string(a, ' ') AS whole FROM s",
    "path_documents": rf"WITH {RECORDS}, s AS (SELECT DISTINCT rule_id, trim(regexp_split_to_array(trim(pattern), '\s+/\s+')[1], ''' \"') AS path FROM g), t AS (SELECT *, {TOKENS} AS a FROM s) SELECT rule_id, path, array_to_string(list_transform(a, lambda x: array_to_string(x, ' ')), ' / ') AS doc, len(a) AS segments FROM t",
    "path_depth_stats": "SELECT len(list_filter(string_split(trim(url, ''' \"'), '/'), lambda x: trim(x) <> '')) AS depth, count(*) AS n FROM pages GROUP BY 1",
    "jaccard_pairs": f"WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT x.p_brand, x.p_name AS a, y.p_name AS b, round(1 - {JACCARD.format('x.p_name', 'y.p_name')}, 6)::DOUBLE AS dist FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.p_name < y.p_name",
    "cosine_pairs": f"WITH {COSINE} SELECT label, i, j, dist FROM near",
    "cosine_components": f"WITH RECURSIVE {COSINE}, {_reach('near', 'vs')} SELECT id AS vec_id, component FROM comp",
    "component_rollup": f"WITH RECURSIVE {COSINE}, {_reach('near', 'vs')}, g AS (SELECT 'R' || label AS rule_id, component, vec_id, vec_id % 7 + 1 AS n FROM embeddings JOIN comp ON vec_id = id), s AS (SELECT rule_id, component, sum(n)::BIGINT AS total_count, count(*) AS merged_variants_count, first('t' || (vec_id % 5) ORDER BY n DESC, vec_id) AS representative_template FROM g GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, component) AS seq FROM s) SELECT 'ai_super' AS group_type, rule_id || '::ai::' || lpad(seq::VARCHAR, 6, '0') AS group_id, rule_id, representative_template, total_count, merged_variants_count, seq FROM o",
    "template_only_clusters": "SELECT p_brand AS rule_id, p_partkey::BIGINT AS gid, min(p_partkey::BIGINT) OVER (PARTITION BY p_brand, left(p_type, 1)) AS component FROM part",
    "weighted_distance": f"WITH p AS (SELECT p_brand, p_name, p_type, p_size > 10 AS big, min(p_partkey) AS gid FROM part GROUP BY ALL), q AS (SELECT a.p_brand, a.gid AS i, b.gid AS j, 1 - {JACCARD.format('a.p_name', 'b.p_name')} AS d0, (a.p_type <> b.p_type)::DOUBLE AS d1, a.big AND b.big AS m FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.gid < b.gid), z AS (SELECT *, CASE WHEN m THEN (0.3::DOUBLE * d0 + 0.7::DOUBLE * d1) / (0.3::DOUBLE + 0.7::DOUBLE) ELSE d0 END AS d FROM q) SELECT p_brand, i, j, round(d, 6)::DOUBLE AS dist FROM z WHERE d <= 0.21",
    "merged_patterns": rf"""WITH {RECORDS}, n AS (SELECT rule_id, count(*) AS n, min_by(pattern, first_seen) AS first_one FROM g GROUP BY 1),
      s AS (SELECT rule_id, first_seen AS ord, regexp_split_to_array(trim(pattern), '\s+/\s+') AS a FROM g WHERE pattern NOT IN ('', 'NO_VAR')), u AS (SELECT rule_id, ord, unnest(range(len(a))) AS slot, unnest(a) AS core FROM s),
      kk AS (SELECT rule_id, slot, core, min(ord) AS ord, string_split(core, '/') AS parts FROM u WHERE core <> 'NO_VAR' GROUP BY 1, 2, 3), h AS (SELECT rule_id, slot, count(*) > 1 AND min(len(parts)) = max(len(parts)) AS even FROM kk GROUP BY 1, 2),
      v AS (SELECT rule_id, slot, ord, even, unnest(CASE WHEN even THEN parts ELSE [core] END) AS atom, unnest(range(CASE WHEN even THEN len(parts) ELSE 1 END)) AS seg FROM kk JOIN h USING (rule_id, slot)),
      w AS (SELECT rule_id, slot, seg, even, atom, min(ord) AS ord FROM v GROUP BY ALL), x AS (SELECT rule_id, slot, seg, count(*) AS c, any_value(even) AS even, string_agg(atom, '|' ORDER BY ord, atom) AS t FROM w GROUP BY 1, 2, 3),
      y AS (SELECT rule_id, slot, string_agg(CASE WHEN c = 1 THEN t WHEN c <= CASE WHEN even THEN 4 ELSE 6 END THEN '{{' || t || '}}' ELSE '*' END, '/' ORDER BY seg) AS t FROM x GROUP BY 1, 2), z AS (SELECT rule_id, string_agg(t, ' / ' ORDER BY slot) AS merged FROM y GROUP BY 1)
      SELECT rule_id, CASE WHEN n = 1 THEN first_one ELSE coalesce(merged, 'NO_VAR') END AS merged FROM n LEFT JOIN z USING (rule_id)""",
    "pairwise_tree": f"WITH {PARTS}, z AS (SELECT *, CASE WHEN f0 <= 0.5 THEN 1 WHEN f1 <= 0.3 THEN 1 ELSE 0 END AS d FROM q) SELECT rule_id, count(*) AS pairs, count(*) FILTER (d = 0) AS merged, sum(CASE WHEN d = 0 THEN i + j ELSE 0 END)::BIGINT AS ids FROM z GROUP BY 1",
    "adaptive_eps": f"WITH {PARTS}, z AS (SELECT *, (1 - f1) / CASE WHEN f1 <= 0.3 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS d FROM q) SELECT rule_id, count(*) FILTER (d <= 1.0) AS merged, round(sum(d), 4)::DOUBLE AS total FROM z GROUP BY 1",
    "suffix_similarity": rf"""WITH {RECORDS}, s AS (SELECT DISTINCT rule_id, trim(regexp_split_to_array(trim(pattern), '\s+/\s+')[1], ''' \"') AS path FROM g), t AS (SELECT *, {TOKENS} AS s FROM s), q AS (SELECT a.rule_id, a.path AS a, b.path AS b, a.s AS x, b.s AS y FROM t a JOIN t b ON a.rule_id = b.rule_id AND a.path < b.path),
      o AS (SELECT *, list_transform(range(-3, 4), lambda h: list_filter(range(0, greatest(len(x), len(y))), lambda k: len(x) - 1 - k >= 0 AND len(y) - 1 - (k + h) >= 0 AND len(y) - 1 - (k + h) < len(y))) AS offs, range(-3, 4) AS hs FROM q),
      m AS (SELECT *, list_transform(range(1, 8), lambda c: CASE WHEN len(offs[c]) = 0 THEN 0.0 ELSE list_sum(list_transform(offs[c], lambda k: pow(0.65, k) * len(list_intersect(x[len(x) - k], y[len(y) - (k + hs[c])])) / len(list_distinct(list_concat(x[len(x) - k], y[len(y) - (k + hs[c])]))))) / list_sum(list_transform(offs[c], lambda k: pow(0.65, k))) END) AS v FROM o)
      SELECT rule_id, a, b, round(list_max(v), 6)::DOUBLE AS similarity FROM m""",
    "tfidf_char_wb": """WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), w AS (SELECT p_brand, p_name, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM d), n AS (SELECT p_brand, p_name, w, unnest(range(3, 7)) AS n FROM w),
      gr AS (SELECT p_brand, p_name, substr(w, unnest(range(1, len(w) - n + 2)), n) AS gram FROM n WHERE n <= len(w)), tf AS (SELECT p_brand, p_name, gram, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT p_brand, gram, count(*) AS df FROM tf GROUP BY ALL), c AS (SELECT p_brand, count(*) AS n FROM d GROUP BY 1),
      r AS (SELECT p_brand, p_name, gram, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (p_brand, gram) JOIN c USING (p_brand)), l AS (SELECT p_brand, p_name, sqrt(sum(w * w)) AS l FROM r GROUP BY ALL), u AS (SELECT p_brand, p_name, gram, w / l AS w FROM r JOIN l USING (p_brand, p_name))
      SELECT a.p_brand, a.p_name AS a, b.p_name AS b, round(sum(a.w * b.w), 6)::DOUBLE AS similarity FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.gram = b.gram AND a.p_name < b.p_name GROUP BY ALL""",
    "pair_f1": f"WITH RECURSIVE {COSINE}, {_reach('near', 'vs')}, rw AS (SELECT label AS truth, component AS predicted FROM embeddings JOIN comp ON vec_id = id), {_counted('rw')}, {_scored('counted')} SELECT * FROM out",
    "gt_completeness": """WITH k AS (SELECT DISTINCT doc_id::VARCHAR AS group_id FROM documents), t AS (SELECT (doc_id + CASE WHEN doc_id % 50 = 7 THEN 10000000 ELSE 0 END)::VARCHAR AS group_id FROM labels)
      SELECT 'duplicate' AS problem, group_id FROM t GROUP BY group_id HAVING count(*) > 1 UNION ALL (SELECT 'missing', group_id FROM k WHERE group_id NOT IN (SELECT group_id FROM t) ORDER BY group_id LIMIT 10) UNION ALL SELECT DISTINCT 'unknown', group_id FROM t WHERE group_id NOT IN (SELECT group_id FROM k)""",
    "level_signal_noise": f"""WITH {RECORDS}, s AS (SELECT line_no AS gid, list_filter(list_transform(string_split(trim(variables[1], ''' "'), '/'), lambda x: trim(x)), lambda x: x <> '') AS a FROM p WHERE variables[1] <> 'NO_VAR'), d AS (SELECT max(len(a)) AS depth FROM s),
      v AS (SELECT gid, depth, unnest(range(depth)) AS level, a FROM s, d), x AS (SELECT gid, depth, level, coalesce(a[level + 1], '') AS value, event_type FROM v JOIN events ON gid = event_id), y AS (SELECT depth, level, event_type, count(DISTINCT value) AS n, min(value) AS value FROM x GROUP BY ALL),
      z AS (SELECT level, max(n) AS within_, count(DISTINCT value) AS between_ FROM y GROUP BY 1), u AS (SELECT depth, level, count(DISTINCT nullif(value, '')) AS n_unique FROM x GROUP BY ALL)
      SELECT 0::BIGINT AS var, depth, level, n_unique, CASE WHEN n_unique <= 1 THEN 'constant' WHEN within_ > 1 THEN 'noise' WHEN between_ > 1 THEN 'signal' ELSE 'constant' END AS signal FROM u JOIN z USING (level)""",
    "leaf_eps": """WITH q AS (SELECT (a.vec_id + b.vec_id) % 4 AS leaf, a.label = b.label AS pos, round(1 - greatest(-1.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS d FROM embeddings a JOIN embeddings b ON a.label // 2 = b.label // 2 AND a.vec_id < b.vec_id),
      s AS (SELECT leaf, max(d) FILTER (pos) AS far, min(d) FILTER (NOT pos) AS near, avg(pos::INT) AS share FROM q GROUP BY 1)
      SELECT leaf, greatest(0.001::DOUBLE, round(CASE WHEN near IS NULL THEN far WHEN far IS NULL THEN greatest(0.001, near * 0.5) WHEN far < near THEN (far + near) / 2 WHEN share >= 0.5 THEN far ELSE greatest(0.001, near * 0.5) END, 3))::DOUBLE AS eps FROM s""",
    "grid_search_topk": f"WITH RECURSIVE {COSINE}, gs AS (SELECT unnest([0.6, 0.7, 0.75, 0.8, 0.85])::DOUBLE AS eps), gp AS (SELECT eps, i, j FROM gs JOIN cp ON dist <= eps), gn AS (SELECT eps, vec_id AS id FROM gs, embeddings), {_reach('gp', 'gn', 'eps')}, rw AS (SELECT eps, label AS truth, component AS predicted FROM embeddings JOIN comp ON vec_id = id), {_counted('rw', 'eps')}, {_scored('counted', 'eps', 6)} SELECT eps, tp, fp, fn, precision, recall, f1 FROM out ORDER BY f1 DESC, precision DESC, eps LIMIT 3",
    "distance_report": f"WITH {COSINE} SELECT i, j, dist, dist <= {EPS} AS merge, true AS gt_same_cluster FROM cp WHERE dist <= 0.9",
    "distinct_texts": "SELECT md5(text) AS text_md5, count(*) AS uses, count(*) AS placed, length(text)::DOUBLE AS first FROM conversations WHERE text IS NOT NULL GROUP BY text",
}
