"""Exact, line and near-duplicate removal against brute force."""

import hashlib
import os
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, jaccard_join, line_dedup
from sievework.llm.shared import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("x"), "n": F.lit(1), "start": F.lit(2), "_spans": F.lit(3)}).repartition(3)


def test_exact(spark):
    texts = ["a b", "ab ", " a\tb", "c", None, "", "\n", "a\u00a0b", "ab", "c", "x" * 100_000, "x" * 100_000 + " "]
    rows = list(enumerate(texts)) + [(3, "c"), (None, "q"), (None, "c")]
    got = exact_dedup.dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    want = []
    for key, members in groups.items():
        keep = min(members)[2]
        want += [(d, keep, len(members), d == keep, hashlib.sha256(key.encode()).hexdigest()) for _, _, d in members]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.dedup(table(spark, rows).where("false")).count() == 0


def test_index_persists_and_new_data_is_held_against_it(spark):
    at = fresh_path(spark, "index-test")
    index = exact_dedup.DigestIndex(spark, at, 4)
    first = exact_dedup.dedup(table(spark, [(1, "a"), (2, "b"), (3, "a ")]), index)
    assert {r.doc_id: r.kept for r in first.collect()} == {1: False, 2: True, 3: True}
    again = exact_dedup.DigestIndex(spark, at, 4)  # another name for the same files
    assert again.read().count() == 2
    second = exact_dedup.dedup(table(spark, [(7, "a"), (8, "new")]), again)
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {7: (3, False), 8: (8, True)}
    plan = again.unseen(exact_dedup.winners(exact_dedup.digests(table(spark, [(9, "z")]))))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.rindex("Exchange") < plan.rindex("Scan ExistingRDD") < plan.rindex("index-test")  # none on the index's side


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_an_index_fed_in_parts_says_what_one_fed_at_once_does(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice(["xx", "x x", "x  x", "y", " y", "", "own"]) + (str(k) if k % 9 == 0 else "")) for k in range(120)]
    tables = {t.name for t in spark.catalog.listTables()}
    want = sorted(map(tuple, exact_dedup.dedup(table(spark, rows)).collect()))
    assert {t.name for t in spark.catalog.listTables()} == tables  # the query's own index is gone
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index-parts"), 4)
    for k in range(parts):
        last = exact_dedup.dedup(table(spark, rows[k::parts]), index)
        last.count()
    assert sorted(map(tuple, last.collect())) == [r for r in want if r[0] % parts == parts - 1]
    read = index.read()
    assert {r.keep_id: r.group_size for r in read.collect()} == {r[1]: r[2] for r in want}
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    index.drop()


def test_hot_group_takes_the_broadcast_way(spark):
    rows = [(k, "same") for k in range(2000)] + [(10_000 + k, f"own {k}") for k in range(100)]
    got = exact_dedup.dedup(table(spark, rows)).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 101, False: 1999}


def near(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}


def brute(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BATCH_SHINGLES", 3000)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", [500, 4000][seed % 2])
    monkeypatch.setattr(jaccard_join, "FREQUENT", [5, 10_000][seed // 2 % 2])
    monkeypatch.setattr(jaccard_join, "MOST_BLOCKS", [1, 16][seed % 2])
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 120]))]
        for _ in range(rng.choice([1, 3, 30])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t + [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 9]))]))
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 8, 40]))) for _ in range(40)]
    texts += ["", "  ", None, "one two", "one two", "ONE two", "É é", "é É"]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    rng.shuffle(rows)
    assert near(spark, rows) == brute(rows)


def chain(rng, n, width=60, step=15):
    """Texts of which each shares words with the next ones, half of them near the threshold: one region without end."""
    words = [f"c{rng.randrange(10**6)}" for _ in range(n * step + width)]
    texts = [words[k * step : k * step + width] for k in range(n)]
    texts += [t[: width - 3] + [f"x{k}"] + t[width - 2 :] for k, t in enumerate(texts[::2])]
    return list(enumerate(" ".join(t) for t in texts))


def test_a_region_that_percolates_is_not_met_as_a_square(spark, monkeypatch):
    """Beyond ``MOST_BLOCKS`` documents meet by shared shingles: no group grows with the region, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(jaccard_join, "MOST_BLOCKS", 2)
    seen, blocks = {}, jaccard_join._blocks

    def watched(open_, found):
        dealt = blocks(open_, found)
        n = open_.select("doc_id").distinct().count()
        seen[n] = (dealt.count(), dealt.groupBy("level", "key", "x", "y").count().agg(F.max("count")).first()[0], {r.level for r in dealt.select("level").distinct().collect()})
        return dealt

    monkeypatch.setattr(jaccard_join, "_blocks", watched)
    for n in (30, 90):
        rows = chain(random.Random(n), n)
        assert near(spark, rows) == brute(rows)
    (small, few), (large, many) = sorted((n, x) for n, x in seen.items())
    assert many[1] <= 2 * few[1], (few, many)  # a group's documents
    assert many[0] / large <= 2 * few[0] / small, (few, many)  # copies of a document


def test_a_shingle_in_every_text_does_not_fill_a_range(spark, monkeypatch):
    """However many batches there are, and with no batch in which it is frequent by itself."""
    monkeypatch.setattr(jaccard_join, "BATCH_SHINGLES", 100)
    rng = random.Random(7)
    rows = [(k, "the same nine words stand in every one text " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(12))) for k in range(240)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(0, 240, 40)]
    n = sum(size for size, _ in brute(rows).values()) // 100
    dealt = jaccard_join._deal(table(spark, rows), n).where("kind = 0").select("low", "high").collect()
    times = defaultdict(int)
    for r in dealt:
        for low, high in zip(*(memoryview(x).cast("I") for x in (r.low, r.high)), strict=True):
            times[low, high] += 1
    assert max(times.values()) <= max(100, n) < 240
    assert near(spark, rows) == brute(rows)


def test_shingles_are_not_all_on_disk_at_once(spark, monkeypatch):
    """Ranges are dealt pass by pass, what a pass shuffled goes with it, and each table of shared shingles in the end."""
    monkeypatch.setattr(jaccard_join, "BATCH_SHINGLES", 2000)
    rng = random.Random(11)
    rows = [(k, " ".join(f"o{rng.randrange(10**9)}" for _ in range(100))) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(0, 400, 4)]
    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    on_disk = lambda: sum(os.path.getsize(os.path.join(at, f)) for d in local for at, _, files in os.walk(d) for f in files if f.endswith(".data"))
    seen, stored, made = [], jaccard_join.materialize, {}

    def watched(df, tag):
        before = on_disk()
        out = stored(df, tag)
        time.sleep(1)  # files are removed behind the query
        seen.append((tag, on_disk() - before))
        made.setdefault(tag, []).append(out)
        return out

    monkeypatch.setattr(jaccard_join, "materialize", watched)
    assert near(spark, rows) == brute(rows)
    assert [t for t, _ in seen].count("owned") == 2
    assert max(size for tag, size in seen if tag in ("owned", "candidates")) <= 0
    assert not any(os.path.exists(f.removeprefix("file://")) for x in made["owned"] for f in x.inputFiles())


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_change_nothing(spark, monkeypatch, passes):
    monkeypatch.setattr(jaccard_join, "BATCH_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "PASSES", passes)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    rows = chain(random.Random(3), 60)
    rows += [(1000 + k, t) for k, t in rows[:20]]
    assert near(spark, rows) == brute(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert near(spark, []) == {}
    got = jaccard_join.near_duplicates(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f")]))
    assert sorted(map(tuple, got.collect()), key=str) == [(3, 2, 3), (4, 2, 3), (None, 2, None)]
    kept = jaccard_join.drop_near_duplicates(table(spark, [(4, "a b c d e f"), (3, "a b c d e f"), (9, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9] and kept.columns[0] == "doc_id"


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_multi_match_prefix_keeps_every_link(k):
    """Of two linked sets the k-prefixes in a common order share k shingles."""
    rng = random.Random(k)
    for _ in range(300):
        pool = list(range(60))
        a = set(rng.sample(pool, rng.randint(4, 40)))
        b = set(a) ^ set(rng.sample(pool, rng.randint(0, 8)))
        both = len(a & b)
        if not b or 100 * both < 75 * len(a | b) or min(-(-75 * len(a) // 100), -(-75 * len(b) // 100)) < k:
            continue
        cut = lambda s: set(sorted(s)[: len(s) - -(-75 * len(s) // 100) + k])
        assert len(cut(a) & cut(b)) >= k


def sentences(rng, n):
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(10_000)) for _ in range(9)).capitalize() + "." for _ in range(n)]


def test_lines_brute(spark):
    rng = random.Random(1)
    long_line, block = " ".join(sentences(rng, 7)), "\n".join(sentences(rng, 9))
    rows = []
    for k in range(30):
        parts = ["\n".join(sentences(rng, 3)), " ".join(sentences(rng, 4))]
        if k % 3 == 0:
            parts.insert(rng.randrange(3), long_line)
        if k % 4 == 0:
            parts.insert(rng.randrange(3), block)
        rows.append((k, "\n".join(parts)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, long_line + "\n" + long_line), (44, rows[5][1]), (None, long_line), (5, rows[5][1])]
    got = line_dedup.dedup(table(spark, rows))
    assert got.columns == [*table(spark, rows).columns, "n_removed"] and got.count() == len(rows)
    places = defaultdict(set)
    for d, t in rows:
        if d is not None and t:
            for s, e in line_dedup.chunks(t):
                places[t[s:e]].add((d, s, e))
    spans = defaultdict(list)
    for found in places.values():
        for d, s, e in sorted(found)[1:]:
            spans[d].append((s, e))
    texts = dict(rows)
    for r in got.collect():
        assert r.text == (texts[r.doc_id] if not texts[r.doc_id] else line_dedup.remove(texts[r.doc_id], spans[r.doc_id] if r.doc_id is not None else []))
    left = [r.text for r in got.where("doc_id is not null and text is not null").collect()]
    assert sum(t.count(long_line) for t in left) == 1  # one long line is found wherever it stands
    assert sum(t.count(block.split("\n")[4]) for t in left) <= 3


def test_repeated_windows_by_brute_force(spark):
    """Passages of whole lines (2, 3, 5 and 10 of them) and of 50 to 120 words in other text, each planted in several
    documents: of the words in 9-word windows that another document has too, and that aren't in a passage's first
    place, nearly all go, and nothing else does. Knows nothing of chunks."""
    rng = random.Random(12)
    rows, planted = [], []
    for k in range(48):
        n = (2, 3, 5, 10, 0, 0)[k % 6]
        passage = "\n".join(sentences(rng, n)) if n else " ".join(" ".join(sentences(rng, 14)).split()[: rng.randint(50, 120)])
        planted.append(passage)
        for _ in range(rng.randint(2, 4)):
            before, after = "\n".join(sentences(rng, rng.randint(0, 5))), "\n".join(sentences(rng, rng.randint(0, 5)))
            rows.append((len(rows), f"{before}\n{passage}\n{after}" if n else f"{before} {passage} {after}"))
    rng.shuffle(rows)
    left = {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows)).collect()}
    texts, window = dict(rows), 9
    first, places = {}, 0
    for d in sorted(texts):
        words = texts[d].split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), d)
    stay = gone = 0
    for d in sorted(texts):
        words, kept = texts[d].split(), set(left[d].split())
        again = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] != d:
                again.update(range(k, k + window))
                places += 1
        gone += sum(words[k] not in kept for k in again)
        stay += sum(words[k] in kept for k in again)
        foreign = [w for k, w in enumerate(words) if k not in again and w not in kept]
        assert not foreign, (d, foreign[:5])
    assert places > 2000 and gone >= 0.9 * (gone + stay), (gone, stay)
    for n in (2, 3, 5, 10):
        copies = [(sum(left[d].count(line) for d in left), sum(texts[d].count(line) for d in texts)) for k, p in enumerate(planted) if (2, 3, 5, 10, 0, 0)[k % 6] == n for line in p.split("\n")]
        assert sum(after <= 1 for after, _ in copies) >= 0.9 * len(copies), n


def test_own_lines_stay(spark):
    rng = random.Random(2)
    rows = [(k, "\n".join(sentences(rng, 6))) for k in range(20)]
    assert {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows)).collect()} == dict(rows)
    assert line_dedup.dedup(table(spark, rows).where("false")).count() == 0


def test_remove():
    assert line_dedup.remove("ab cd ef\nx\ny", [(0, 8)]) == "x\ny"
    assert line_dedup.remove("ab cd ef\nx\ny", [(3, 5)]) == "ab ef\nx\ny"
    assert line_dedup.remove("ab\ncd\nef", [(0, 5), (3, 5)]) == "ef"
    assert line_dedup.remove("ab\n\ncd", []) == "ab\n\ncd"


def test_cuts_resist_shifts():
    rng = random.Random(3)
    passage, lead = sentences(rng, 40), sentences(rng, 5)
    a = {t[s:e] for t in ["\n".join(passage)] for s, e in line_dedup.chunks(t)}
    b = {t[s:e] for t in ["\n".join(lead + passage)] for s, e in line_dedup.chunks(t)}
    assert len(a & b) >= len(a) - 3


def test_passages_glued_into_other_text_are_found_by_their_own_words():
    """Passages of 50 to 120 words, in the midst of lines of otherwise different texts."""
    rng = random.Random(5)
    words = lambda n: " ".join(sentences(rng, n // 9 + 1)).split()[:n]
    shares = []
    for _ in range(60):
        passage = " ".join(words(rng.randint(50, 120)))
        texts = [" ".join([*words(rng.randint(5, 80)), passage, *words(rng.randint(5, 80))]) for _ in range(2)]
        known = {texts[0][s:e] for s, e in line_dedup.chunks(texts[0])}
        at = texts[1].index(passage)
        held = {p for s, e in line_dedup.chunks(texts[1]) if texts[1][s:e] in known for p in range(s, e)}
        assert held <= set(range(at, at + len(passage)))
        shares.append(len(held) / len(passage))
    assert min(shares) > 0.4 and sum(shares) / len(shares) > 0.8


def test_chunks_of_texts_cut_together_are_those_of_each_alone():
    rng = random.Random(6)
    texts = ["\n".join(" ".join(sentences(rng, rng.randint(1, 4))) for _ in range(rng.randint(1, 6))) for _ in range(20)]
    texts += ["", "\n\n", "short", "a b\nc d\n" * 20, "漢字" * 60 + "。\n" + "仮名" * 60, "one 😀 two " * 9, "x " * 500]
    which, starts, ends, _ = line_dedup.cut(texts)
    for k, t in enumerate(texts):
        assert [(int(s), int(e)) for s, e in zip(starts[which == k], ends[which == k], strict=True)] == line_dedup.chunks(t)
    assert line_dedup.chunks(texts[23]) and line_dedup.chunks(texts[24])
