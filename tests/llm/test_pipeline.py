"""The pipeline's stages, each on its own input, and the registry."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from sievework.llm import jaccard_join, line_dedup, packing, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    done = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == names
        done.append((docs, {r.doc_id: r for r in rows}))
        docs = spark.createDataFrame(rows, out.schema)
    (first, kept), (second, lines), (third, classes), (fourth, masked) = done
    assert set(kept) == {r.doc_id for r in quality.judge(first, labels).where("kept").collect()} and 0 < len(kept) < first.count()
    assert {d: r.text for d, r in lines.items()} == {r.doc_id: r.text for r in line_dedup.dedup(second).collect()} and set(lines) == set(kept)
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(classes) == {r.component_id for r in jaccard_join.near_duplicates(third).collect()}
    assert set(masked) == set(classes) and all(not secrets.base_spans(r.text) for r in masked.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(masked)
    assert packed.agg(F.sum("length")).first()[0] == packing.pieces(docs).agg(F.sum("length")).first()[0]


def test_stages_take_any_columns_nulls_and_repeated_rows(spark):
    """Columns that operators name themselves, dots in names, null texts and ids, ties and repeated rows."""
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = prose(60)
    rows = [(k, prose(40) + "\n" + shared + "\n" + f"password=abcdef{k:06d}x " + prose(30), k) for k in range(12)]
    rows += [(3, rows[3][1], 3), (3, rows[3][1], 3), (20, None, None), (21, "", 0), (None, prose(50), 1), (22, rows[5][1], 5), (23, "x" * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clashing = ("n_removed", "a.b", "row", "digest", "base", "runs", "kept", "score", "lang", "source", "length", "_spans", "value")
    docs = docs.withColumns({c: F.lit(c) for c in clashing}).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name == "best-fit packing":
            assert sorted({r.doc_id for r in got if r.doc_id is not None}) == sorted({r[0] for r in rows if r[0] is not None})
            continue
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in clashing), name
        ids = sorted((r.doc_id for r in got), key=str)
        want = sorted((r[0] for r in rows), key=str)
        if name in ("line dedup", "secret scans"):
            assert ids == want and [r.text for r in got if r.doc_id == 20] == [None] and [r.text for r in got if r.doc_id == 21] == [""]
            assert len({r.text for r in got if r.doc_id == 3}) == 1  # repeated rows have one result
            assert name == "line dedup" or not any("password=" in (r.text or "") for r in got)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        else:
            assert set(ids) <= set(want)
        if name == "n-gram Jaccard join":
            assert {5, 22} & set(ids) == {5} and None in ids and {20, 21} <= set(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("offset + length > 2048").count() == 0


def test_registered_once():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
