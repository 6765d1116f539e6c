"""Features of pairs of groups, and decision trees over them as column expressions.

What depends on one group is computed before groups meet; a tree becomes nested conditions, which look at a feature
only on the way that a pair takes. A rule's groups meet by two of its blocks at a time, so that a rule with most groups
is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.config import Tree
from sievework.operators.distance import dealt_blocks

#: Groups of a block, and n-grams whose weights are multiplied at a time.
BLOCK = 250
SLAB = 8192
TFIDF = "path_tfidf_char_wb"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def suffix_similarity(a: Column, b: Column, max_shift: int = 3, decay: float = 0.65) -> Column:
    """Token overlap of two segment sequences aligned from their ends, the best over shifts; far segments count less."""

    def at_shift(shift: Column) -> Column:
        left = lambda k: F.size(a) - 1 - k
        right = lambda k: F.size(b) - 1 - (k + shift)
        inside = lambda k: (left(k) >= 0) & (right(k) >= 0) & (right(k) < F.size(b))
        steps = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1), inside)

        def mean(offsets: Column) -> Column:
            weight = lambda k: F.pow(F.lit(decay), k)
            num = F.aggregate(offsets, F.lit(0.0), lambda s, k: s + weight(k) * T.jaccard_similarity(F.array_distinct(F.get(a, left(k))), F.array_distinct(F.get(b, right(k)))))
            den = F.aggregate(offsets, F.lit(0.0), lambda s, k: s + weight(k))
            return F.when(den > 0, num / den).otherwise(0.0)

        return _let(steps, mean)

    return F.array_max(F.transform(F.sequence(F.lit(-max_shift), F.lit(max_shift)), at_shift))


def char_ngrams(document: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams within words, each word with a space at either end. A word no longer than n is one gram, and
    longer n are not tried for it."""
    words = F.filter(F.split(F.lower(document), T.U + r"\s+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        top = F.least(F.lit(high), F.greatest(F.lit(low), F.length(word)))
        of = lambda n: F.when(F.length(word) <= n, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda k: F.substring(word, k, n)))
        return F.flatten(F.transform(F.sequence(F.lit(low), top), of))

    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def meeting(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of a rule's rows (``rule_id``, ``gid``, others): ``i`` < ``j`` and the others with ``i_`` and ``j_``.

    Row ``i`` goes to the groups (its block, any), row ``j`` to (any, its block), so every pair meets once.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("rule_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    dealt = rows.join(sizes, "rule_id").withColumn("_own", F.pmod(F.xxhash64("gid"), F.col("_blocks"))).withColumn("_any", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    others = [c for c in rows.columns if c not in ("rule_id", "gid")]

    def side(c: str, own: str, other: str) -> DataFrame:
        return dealt.select("rule_id", F.col("_own").alias(own), F.col("_any").alias(other), F.col("gid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in others)).repartition(n, "rule_id", "_x", "_y")

    return side("i", "_x", "_y").hint("merge").join(side("j", "_y", "_x"), ["rule_id", "_x", "_y"]).where("i < j").drop("_x", "_y")


def tfidf_vectors(documents: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """``rule_id``, ``gid`` and the vector of length 1 of each document (``rule_id``, ``gid``, ``doc``): 64-bit hashes of
    its grams and their weights. Frequencies are those of the rule."""
    grams = documents.select("rule_id", "gid", F.explode(char_ngrams(F.col("doc"), low, high)).alias("gram"))
    tf = grams.groupBy("rule_id", "gid", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("rule_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    n = documents.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(df, ["rule_id", "gram"]).join(n, "rule_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    held = raw.groupBy("rule_id", "gid").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("gram"), "w")).alias("g"))
    length = F.sqrt(F.aggregate("g.w", F.lit(0.0), lambda s, w: s + w * w))
    return held.select("rule_id", "gid", F.col("g.gram").alias("grams"), F.transform("g.w", lambda w: w / length).alias("weights"))


def _products(grams: list, weights: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The products of the ``left`` and ``right`` ones of some vectors, a slab of grams at a time."""
    sizes = [len(x) for x in grams]
    out = np.zeros((len(left), len(right)))
    if not sum(sizes):
        return out
    names, at = np.unique(np.concatenate(grams), return_inverse=True)
    owner, weight = np.repeat(np.arange(len(grams)), sizes), np.concatenate(weights)
    for start in range(0, len(names), SLAB):
        inside = (at >= start) & (at < start + SLAB)
        part = np.zeros((len(grams), min(SLAB, len(names) - start)))
        part[owner[inside], at[inside] - start] = weight[inside]
        out += part[left] @ part[right].T
    return out


def _vectors_of(table) -> tuple[dict, list, list]:
    ids = {g: k for k, g in enumerate(table.column("gid").to_pylist())}
    read = lambda name, dtype: [np.array(x or (), dtype=dtype) for x in table.column(name).to_pylist()]
    return ids, read("grams", np.int64), read("weights", np.float64)


def similarities(documents: DataFrame, low: int, high: int, name: str, wanted: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The ``wanted`` pairs (``rule_id``, ``i``, ``j``, others), or all pairs of a rule, with their TF-IDF cosine as
    ``name``. Two blocks of a rule are multiplied in one task; no gram gathers its documents anywhere."""
    ready = documents.select("rule_id", "gid").join(tfidf_vectors(documents, low, high), ["rule_id", "gid"], "left")
    dealt = dealt_blocks(ready, "rule_id", "gid", block)
    kind = documents.schema["gid"].dataType.simpleString()
    if wanted is None:

        def run(table):
            import pyarrow as pa

            table = table.sort_by("gid")
            ids, grams, weights = _vectors_of(table)
            own, x, y = table.column("own").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            p, q = np.divmod(np.arange(len(left) * len(right)), max(1, len(right)))
            if x == y:
                p, q = p[p < q], q[p < q]
            products = _products(grams, weights, left, right)[p, q]
            a, b = np.minimum(left[p], right[q]), np.maximum(left[p], right[q])  # in the order of ids
            gid = table.column("gid").combine_chunks()
            return pa.table({"rule_id": pa.array([table.column("rule_id")[0].as_py()] * len(a), pa.string()), "i": gid.take(pa.array(a, pa.int64())), "j": gid.take(pa.array(b, pa.int64())), name: pa.array(products, pa.float64())})

        return dealt.groupBy("rule_id", "x", "y").applyInArrow(run, f"rule_id string, i {kind}, j {kind}, `{name}` double")

    sizes = ready.groupBy("rule_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks"))
    placed = wanted.join(sizes, "rule_id").withColumns({"_x": F.least(own("i"), own("j")), "_y": F.greatest(own("i"), own("j"))}).drop("_blocks")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema), f"`{name}` double"])

    def judge(pairs, table):
        import pyarrow as pa

        pairs = pairs.drop_columns(["_x", "_y"])
        ids, grams, weights = _vectors_of(table)
        at = [np.array([ids[g] for g in pairs.column(c).to_pylist()], dtype=np.int64) for c in "ij"]
        (left, p), (right, q) = (np.unique(x, return_inverse=True) for x in at)
        return pairs.append_column(name, pa.array(_products(grams, weights, left, right)[p, q], pa.float64()))

    return placed.groupBy("rule_id", "_x", "_y").cogroup(dealt.withColumnsRenamed({"x": "_x", "y": "_y"}).groupBy("rule_id", "_x", "_y")).applyInArrow(judge, schema)


def tfidf_similarity(documents: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """``rule_id``, ``i``, ``j`` (i < j), ``similarity`` of documents (``rule_id``, ``gid``, ``doc``) that share a gram."""
    return similarities(documents, low, high, "similarity").where("similarity > 0")


def prepared(groups: DataFrame, specs: tuple[dict, ...]) -> DataFrame:
    """``rule_id``, ``gid`` and what the features ask of each group alone, one column ``own0``, ``own1``, ... for each."""
    path = T.primary_path(F.col("pattern"))

    def own(spec: dict) -> Column:
        kind, levels = spec["kind"], spec.get("levels")
        chosen = T.select_levels(F.col("path"), list(levels)) if levels else F.lit("")
        known = {"suffix_similarity": T.segment_tokens, "path_length_equal": lambda p: F.size(T.segment_tokens(p)), "path_length_diff": lambda p: F.size(T.segment_tokens(p)),
                 "level_jaccard": lambda _: T.token_set(chosen), "level_exact": lambda _: chosen}
        return known[kind](F.col("path"))

    ready = groups.select("rule_id", "gid", path.alias("path"))
    return ready.select("rule_id", "gid", *(own(s).alias(f"own{k}") for k, s in enumerate(specs) if s["kind"] != TFIDF))


def feature(spec: dict, a: Column, b: Column) -> Column:
    """A feature of two groups from what :func:`prepared` has of each."""
    kind = spec["kind"]
    if kind == "suffix_similarity":
        return suffix_similarity(a, b, spec.get("max_shift", 3), spec.get("decay", 0.65))
    if kind == "level_jaccard":
        return T.jaccard_similarity(a, b)
    if kind == "level_exact":
        return ((a == b) & (a != "")).cast("double")
    if kind == "path_length_equal":
        return (a == b).cast("double")
    if kind == "path_length_diff":
        return F.abs(a - b).cast("double")
    raise ValueError(f"{kind} is no feature of two rows alone")


def pair_features(groups: DataFrame, specs: tuple[dict, ...], wanted: DataFrame | None = None) -> DataFrame:
    """``rule_id``, ``i``, ``j`` and a column ``f0``, ``f1``, ... for each feature, for all pairs of a rule's groups or
    the ``wanted`` ones."""
    ready = prepared(groups, specs)
    for k, spec in enumerate(specs):
        if spec["kind"] == TFIDF:
            path = T.primary_path(F.col("pattern"))
            wanted = similarities(groups.select("rule_id", "gid", T.path_document(path).alias("doc")), *spec.get("ngram_range", (3, 6)), f"f{k}", wanted)
    if wanted is None:
        both = meeting(ready)
    else:
        side = lambda c: ready.select("rule_id", F.col("gid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ready.columns[2:]))
        both = wanted.join(side("i"), ["rule_id", "i"]).join(side("j"), ["rule_id", "j"])
    alone = [(k, s) for k, s in enumerate(specs) if s["kind"] != TFIDF]
    others = [c for c in (wanted.columns if wanted is not None else ()) if c not in ("rule_id", "i", "j") and c not in {f"f{k}" for k in range(len(specs))}]
    made = {k: feature(s, F.col(f"i_own{k}"), F.col(f"j_own{k}")).alias(f"f{k}") for k, s in alone}
    return both.select("rule_id", "i", "j", *others, *(made.get(k, F.col(f"f{k}")) for k in range(len(specs))))


def tree_value(tree: Tree, node: int = 0) -> Column:
    """The leaf that a pair with columns ``f0``, ``f1``, ... comes to."""
    n = tree.nodes[node]
    if "value" in n:
        return F.lit(float(n["value"]))
    return F.when(F.col(f"f{n['feature']}") <= n["threshold"], tree_value(tree, n["left"])).otherwise(tree_value(tree, n["right"]))


def tree_pairs(groups: DataFrame, tree: Tree) -> DataFrame:
    """Pairs with the leaf as distance: 0 or 1 for a pairwise tree."""
    return pair_features(groups, tree.features).select("rule_id", "i", "j", tree_value(tree).alias("dist"))


def adaptive_pairs(groups: DataFrame, base: DataFrame, tree: Tree) -> DataFrame:
    """Base distances divided by the threshold of each pair's leaf; pairs merge at 1 or less."""
    known = pair_features(groups, tree.features, base)
    return known.select("rule_id", "i", "j", (F.col("dist") / tree_value(tree)).alias("dist"))
