"""Removal of passages that repeat across documents, by content-defined chunks.

Words are hashed. Within a line a unit ends where the hash of two neighbouring words is the least of those up to
``REACH`` words on either side, and each line ends one; so a unit's ends depend on a few words around them only, and
equal passages are cut alike whatever stands before and after them, in the same line or not. Every ``UNITS`` units in
a row are a chunk (more, forward and backward, where these have under ``LEAST_CHARS`` characters), so chunks overlap and
hold all between a passage's first and last shared end. A line of one unit is a chunk if it has several sentences. A
chunk's digest is counted over all documents. Of the places of a digest the first (by ``doc_id``, then position) keeps
its chunk. Every other place is compared with the first one's bytes and loses the chunk if they are equal. A line of
which nothing stays goes with its line break.

Results for odd input: a null text stays null and an empty one empty; rows that share a ``doc_id`` count as one
document, so repeated rows have equal results; rows with a null ``doc_id`` stay as they are; blank lines and what no
chunk holds are never removed; an empty table gives an empty result.

A document's chunks are gathered by document only, so no task holds more than a document's share; a digest with many
places meets its first place in joins that can be split. Before rows go to a join, those whose key can't be on its other
side are told by a broadcast set of hashed keys. The set has a fixed number of cells, so it stays small whatever the
input; if it fills up, more rows go to the join and the result is the same. Texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.shared import materialize, small_batches

#: Units of a chunk, its least length, and the words on either side among which a unit's end has the least hash.
UNITS, LEAST_CHARS, REACH = 2, 40, 3
SENTENCE_END = re.compile(r"(?<=[.!?])\x20+(?=\S)")
#: A line of one unit and of more characters is a chunk, even if it is one sentence.
LONG_SENTENCE = 160
#: From here on characters belong to scripts without spaces; each is a word.
IDEOGRAMS = 0x2E80
#: Characters that are cut at a time, if they are several texts.
CUT_CHARS = 1 << 18
FACTOR = 0x9E3779B97F4A7C15
MOST = np.uint64(2**64 - 1)
#: Cells of a set of hashed keys.
CELLS = 1 << 20
PLACES = "doc_id long, digest long, start int, end int"


_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((FACTOR, pow(FACTOR, -1, 2**64))):
            steps = np.full(max(n, CUT_CHARS + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    space = (points == 32) | (points >= 9) & (points <= 13)
    alone = points >= IDEOGRAMS
    first = ~space
    first[1:] &= space[:-1] | alone[1:] | alone[:-1]
    last = ~space
    last[:-1] &= space[1:] | alone[1:] | alone[:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1

def _sums(points: np.ndarray) -> np.ndarray:
    """Sums of the characters' hashes times powers of the factor, before each place."""
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points + np.uint64(1)) * _power_tables(len(points) + 1)[0][: len(points)], out=total[1:])
    return total


def _hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the pieces from ``starts`` to ``ends``, the same wherever a piece stands."""
    return _mixed((total[ends] - total[starts]) * _power_tables(len(total))[1][starts])


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of ``texts``: which text, where they start and end in it, and their digests."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = _words(points)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    total = _sums(points)
    own = _hashes(total, starts, ends)
    line = np.cumsum(points == 10)[starts]
    inner = line[1:] == line[:-1]
    value = np.full(len(starts), MOST)  # of the end after each word
    value[:-1][inner] = _mixed(own[:-1] * np.uint64(FACTOR) + own[1:])[inner]
    nth = np.cumsum(np.concatenate([[0], ~inner]))
    at = np.arange(len(starts)) + REACH * (nth + 1)  # lines lie apart, so that they don't count for each other
    row = np.full(at[-1] + REACH + 1, MOST)
    row[at] = value
    ending = np.concatenate([~inner, [True]])
    least = value < MOST
    for d in range(1, REACH + 1):
        least &= (value < row[at + d]) & (value <= row[at - d])
    unit_last = np.flatnonzero(ending | least)
    unit_first = np.concatenate([[0], unit_last[:-1] + 1])
    begin, end, line = starts[unit_first], ends[unit_last], line[unit_first]
    k = np.arange(len(begin))
    forward = np.maximum(k + UNITS - 1, np.searchsorted(end, begin + LEAST_CHARS))
    backward = np.minimum(k - UNITS + 1, np.searchsorted(begin, end - LEAST_CHARS, "right") - 1)
    a, b = np.concatenate([k, backward]), np.concatenate([forward, k])
    real = (a >= 0) & (b < len(begin))
    pairs = np.sort(a[real] * len(begin) + b[real])
    a, b = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(begin))
    alone = np.concatenate([[True], line[1:] != line[:-1]]) & np.concatenate([line[1:] != line[:-1], [True]]) & (end - begin >= LEAST_CHARS)
    text_of = np.searchsorted(offsets, begin, "right") - 1
    told = [u for u in np.flatnonzero(alone).tolist() if end[u] - begin[u] > LONG_SENTENCE or SENTENCE_END.search(texts[text_of[u]], begin[u] - offsets[text_of[u]], end[u] - offsets[text_of[u]])]
    same = text_of[a] == text_of[b]
    a, b = np.concatenate([a[same], told]).astype(np.int64), np.concatenate([b[same], told]).astype(np.int64)
    at = offsets[text_of[a]]
    return text_of[a], begin[a] - at, end[b] - at, _hashes(total, begin[a], end[b]).view(np.int64)


def chunks(text: str) -> list[tuple[int, int]]:
    """The chunks of a text, as places in it."""
    _, starts, ends, _ = cut([text])
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the ``spans``; lines that they leave blank go."""
    if not spans:
        return text
    spans = sorted(spans)
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        kept, here, touched = [], at, False
        for s, e in spans[k:]:
            if s >= end:
                break
            touched = True
            if s > here:
                kept.append(text[here:s])
            here = max(here, e)
        if not touched:
            out.append(line)
        else:
            kept.append(text[here:end] if here < end else "")
            rest = " ".join(x.strip(" ") for x in kept if x.strip(" "))
            if rest:
                out.append(rest)
        at = end + 1
    return "\n".join(out)


def places(docs: DataFrame) -> DataFrame:
    """Every chunk of ``docs`` (``doc_id``, ``text``) with its digest."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def found(ids: list[int], texts: list[str]):
            which, starts, ends, digests = cut(texts)
            owner = np.array(ids, np.int64)[which]
            return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(digests), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["doc_id", "digest", "start", "end"])

        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if texts and size + len(text) > CUT_CHARS:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 1
            yield found(ids, texts)

    return docs.mapInArrow(run, PLACES)


def _split(rows: DataFrame, key: Column, others: DataFrame, other: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among the ``others``, and rows whose key is not."""
    cell = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(CELLS)), F.lit(-1))
    cells = F.broadcast(materialize(others.select(cell(other).alias("_cell")).distinct(), "cells"))  # CELLS rows at most
    return tuple(rows.withColumn("_cell", cell(key)).join(cells, "_cell", how).drop("_cell") for how in ("left_semi", "left_anti"))


def _originals(listed: DataFrame) -> DataFrame:
    """The text of each digest in its first document (``doc_id``, ``text``, ``own``: digests with their places)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            digests, texts = [], []
            for text, own in ((x.as_py() for x in row) for row in zip(b.column(0), b.column(1), strict=True)):  # one row's objects at a time
                for digest, (start, end) in {x["digest"]: (x["start"], x["end"]) for x in sorted(own, key=lambda x: -x["start"])}.items():
                    digests.append(digest)
                    texts.append(text[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(texts, pa.string())], ["digest", "original"])

    return listed.select("text", "own").mapInArrow(run, "digest long, original string")


def dedup(docs: DataFrame, removed: str | None = "n_removed") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and the column ``removed``, the characters taken out.

    Without ``removed`` there is no such column; a name that ``docs`` has already gets an underscore more.
    """
    small_batches(docs.sparkSession)
    while removed in docs.columns:
        removed += "_"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = materialize(places(texts), "chunks")
    repeated = materialize(found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    some = _split(found, F.col("digest"), repeated, F.col("digest"))[0] if repeated.count() < CELLS else found  # a full set tells nothing
    placed = materialize(some.join(repeated, "digest"), "placed")
    own, others = placed.where("doc_id = first").drop("first"), placed.where("doc_id <> first").drop("first")
    by_first = own.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "start", "end")).alias("own"))
    originals = _originals(_split(texts, F.col("doc_id"), own, F.col("doc_id"))[0].join(by_first, "doc_id"))
    copies = others.join(originals, "digest").select("doc_id", "start", "end", "original", F.lit(None).cast("int").alias("at"))
    again = own.groupBy("doc_id", "digest").agg(F.min("start").alias("at"), F.max("start").alias("last")).where("at < last").drop("last")
    within = own.join(again, ["doc_id", "digest"]).where("start > at").select("doc_id", "start", "end", F.lit(None).cast("string").alias("original"), "at")
    spans = copies.unionByName(within).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "original", "at")).alias("_spans"))
    spans = materialize(spans.withColumnRenamed("doc_id", "_document"), "spans")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # so that names can't clash
    key = F.col("row.doc_id").cast("long")
    some, rest = _split(whole, key, spans, F.col("_document"))
    touched = some.join(spans, key == F.col("_document"), "left").select("row", "_spans")
    names, at = docs.columns, docs.columns.index("text")
    schema = StructType([*touched.schema["row"].dataType.fields, *([StructField(removed, LongType())] if removed else [])])

    def equal(text: str, x: dict) -> bool:
        own = text[x["start"] : x["end"]]
        return own == (x["original"] if x["original"] is not None else text[x["at"] : x["at"] + len(own)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = b.column(0).flatten()
            texts = columns[at].to_pylist()
            out = [remove(t, [(x["start"], x["end"]) for x in spans.as_py() or () if equal(t, x)]) if t else t for t, spans in zip(texts, b.column(1), strict=True)]  # one row's spans at a time
            columns[at] = pa.array(out, pa.string())
            if removed:
                columns.append(pa.array([len(t or "") - len(x or "") for t, x in zip(texts, out, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*names, removed][: len(columns)])

    left = rest.select("row.*", *([F.lit(0).cast("long").alias(removed)] if removed else []))
    return touched.mapInArrow(run, schema).union(left)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text that stays, its digest and the characters taken out, for every row."""
    done = dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"), "text")
