"""Quality rules: counts of a text's form, and a hashed n-gram log-likelihood ratio.

A text's words and pairs of neighbouring words are hashed to a fixed number of cells. Over these cells two multinomials
are estimated, one from a trusted target (all documents labelled as good) and one from the whole raw corpus. A text's
score is the sum of its cells' log ratios divided by their number; a text is kept if it passes the base rules and its
score isn't under the threshold. Log ratios are whole millionths, so a sum doesn't depend on its order. Everything is
DataFrame functions: the words are exploded and joined with the table of cells, whose size is fixed, and what is exploded
is summed by row before any exchange. Of the texts only those that may be of the target are dealt out, to meet their labels.

Results for odd input: a null or empty text has no words, fails the base rules and has no score; repeated rows are
judged one by one; without labels, or without any labelled as good, the score is 0 for all texts and the base rules
decide. An empty table gives an empty result. The documents should come from stored files, as rows are numbered by their
place in a split, which has to be the same when a split is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import SPACE_CLASS, WORD_PATTERN, documents, materialize

#: Cells of the hashed n-grams; the table that is broadcast has as many rows at most.
CELLS = 1 << 17
#: Bits of the set of hashed ids that tells which documents may be of the target, 64 of them in a row of its broadcast table.
BITS = 1 << 24
#: Mean log ratio, in nats an n-gram, under which a text is more like the rest of the corpus than like the target.
THRESHOLD = -0.25
#: Added to each cell of either multinomial.
SMOOTHING = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
MILLION = 1_000_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, though ``body`` names it within lambdas."""
    return F.transform(F.array(value), body)[0]


def neighbours(hashes: Column, step: int) -> Column:
    """The hash of each element with the one ``step`` places on."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda x, i: F.xxhash64(x, hashes[i + step]))


def repeated_words(pairs: Column, n_words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more, from the hashes of neighbouring words.

    A window's 64-bit hash is made of those of its halves. The positions of repeated windows come from one sort;
    neighbouring windows count their common words once.
    """
    window = WINDOW
    hashes = _let(neighbours(pairs, 2), lambda fours: neighbours(fours, 4))

    def covered(at: Column) -> Column:
        step = lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(window), at[k + 1] - p)).otherwise(window)
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    def repeats(found: Column) -> Column:
        twice = lambda x, k: ((k > 0) & (found[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k + 1 < F.size(found)) & (found[F.least(k + 1, F.size(found) - 1)]["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(found, twice), lambda x: x["i"]))

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed(h), lambda s: _let(repeats(s), covered))))
    return F.when(n_words < window, F.lit(0)).otherwise(count).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def hashed(texts: DataFrame) -> DataFrame:
    """``texts`` with the hashes of the ``words`` of ``text`` and of ``pairs`` of neighbouring words."""
    words = texts.select("*", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    one = words.select(*texts.columns, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return one.select("*", neighbours(F.col("words"), 1).alias("pairs"))


def base(docs: DataFrame) -> DataFrame:
    """The counts of each text; the hashes stay for what follows."""
    n = F.size("words").cast("long")
    counted = hashed(documents(docs)).select(
        "doc_id", "words", "pairs", n.alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("pairs"), n).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` of every row, and ``trusted``: 1 if it is labelled as good, else 0.

    Only rows whose hashed id is also one of a good label are dealt out for the join, always by a merge of sorted ids. The
    set of hashed ids has a fixed size; the fuller it gets, the more rows go to the join, and the result is the same.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    place, within = F.floor(bit / 64).cast("int"), (bit % 64).cast("int")
    found = good.select(place.alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), within).alias("bits"))
    bits = materialize(found.groupBy("place").agg(F.bit_or("bits").alias("bits")), "good-bits")
    told = documents(docs).withColumn("place", place).join(F.broadcast(bits), "place", "left")
    told = told.select("doc_id", "text", F.coalesce(F.getbit("bits", within), F.lit(0)).alias("maybe"))
    others = told.where("maybe = 0").select("text", F.lit(0).alias("trusted"))
    met = told.where("maybe = 1").join(good.withColumn("trusted", F.lit(1)).hint("merge"), "doc_id", "left")
    return others.unionByName(met.select("text", F.coalesce("trusted", F.lit(0)).alias("trusted")))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``cell`` and ``ratio``: the logarithm of target over raw frequency, in millionths."""
    flagged = hashed(trusted(docs, labels))
    grams = flagged.select("trusted", F.explode(F.concat("words", "pairs")).alias("gram"))
    counts = grams.groupBy(F.pmod("gram", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    counts = materialize(counts, "cells")
    whole = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")).first()
    n_raw, n_target = float(whole["all_raw"] or 0), float(whole["all_target"] or 0)
    share = lambda c, n: (F.col(c) + SMOOTHING) / F.lit(n + SMOOTHING * CELLS)
    ratio = F.log(share("target", n_target) / share("raw", n_raw)) if n_target else F.lit(0.0)
    return counts.select("cell", F.round(ratio * MILLION).cast("long").alias("ratio"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's counts, ``base_failed``, ``score`` and ``kept``."""
    ratios = log_ratios(docs, labels)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = base(docs).select(F.monotonically_increasing_id().alias("row"), *counts, F.concat("words", "pairs").alias("grams"))
    exploded = rows.select("row", *counts, F.explode_outer("grams").alias("gram"))  # after the numbering of rows
    grams = exploded.select("row", *counts, F.pmod("gram", F.lit(CELLS)).cast("int").alias("cell"))
    summed = grams.join(F.broadcast(ratios), "cell", "left").groupBy("row").agg(*(F.first(c).alias(c) for c in counts), F.sum("ratio").alias("total"), F.count("cell").alias("n_grams"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / MILLION)
    kept = ~F.col("base_failed") & (F.coalesce(score, F.lit(0.0)) >= threshold)
    return summed.select(*counts, score.alias("score"), kept.alias("kept"))
