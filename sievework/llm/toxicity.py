"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are all words of a text and their first letters (``PREFIXES``), hashed to ``CELLS`` cells. Document frequencies
are counted over all documents, and a text's vector has every one of its features with the weight (1 + ln tf) * idf.
A bounded sample of labelled documents of both labels is an inverted index: for each feature the examples that have it.
The lists of frequent features are cut into blocks of examples, with the greatest weight of each block. A text adds up
its rare features' lists, bounds each block by that and the greatest weights, and takes its most promising blocks first;
of the others only those whose bound reaches its k-th best cosine are looked at, so the k nearest are exact. Similar
examples share blocks, which keeps the bounds of blocks in other languages low.

Neighbours vote by their cosine, the first 15, 50, 100 and 200 apart. The examples' own votes, each without itself, fit
a logistic curve that turns the votes into a probability at the rate of the labels. Labels are learnt only from rows whose
hash of the id isn't held out; nothing else is chosen by labels, and nothing but the text makes a score.

Results for odd input: a null or empty text, or one that shares no feature with any example, has no neighbours and the
rate of label 1 as its score; repeated rows give equal results; of rows that share a labelled ``doc_id`` the smallest
text is the example; a repeated label counts once, the greatest if they differ, null labels not at all; without
examples of both labels every score is the rate, 0 without any. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import documents, materialize, small_batches

#: Examples of each label at most, in the order of a hash of their ids.
EXAMPLES = 2048
#: Cells of the hashed features; the table of frequencies that workers get has as many numbers.
CELLS = 1 << 20
#: Lengths of the beginnings of a word that are features beside the word.
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
#: Numbers of neighbours whose votes are taken, and examples of a block.
NEIGHBOURS, BLOCK = (15, 50, 100, 200), 128
#: Neighbours that a result names.
EVIDENCE = 5
#: Words whose features a worker remembers, and texts whose neighbours it does.
KNOWN_WORDS, KNOWN_TEXTS = 200_000, 20_000
#: The most frequent features of the examples, whose lists are cut into blocks, and texts that are looked up together.
COMMON, TEXTS = 1024, 128

WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def word_cells(word: str) -> list[int]:
    """The cells of the word, with its ends marked, and of its beginnings; -1 where it is no longer than one."""
    n = len(word)
    return [crc32(f" {word} ".encode()) % CELLS, *(crc32(f" {word[:k]}".encode()) % CELLS if n > k else -1 for k in PREFIXES)]


class Features:
    """The cells of a text's features."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, 1 + len(PREFIXES)), np.int32)

    def cells(self, words: list[str]) -> np.ndarray:
        """One row for each of the different ``words``, -1 where it has no more features."""
        if len(self.known) >= KNOWN_WORDS:
            self._clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(new)), 1 + len(PREFIXES)), np.int32)])
            self.table[first : len(known)] = [word_cells(w) for w in new]
        return self.table[[known[w] for w in words]] if words else self.table[:0]

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The cells of all features in order, and how often each is in the text."""
        words = Counter(WORD.findall(text.lower()))
        found = self.cells(list(words))
        real = found >= 0
        every = found[real]
        if not len(every):
            return every, np.zeros(0, np.int64)
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), real.sum(axis=1))
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        return every[first], np.add.reduceat(times[order], first)


#: A cell is stored as its low 16 bits, after the numbers of cells by their high bits; a count as a byte, and those from 255 on apart.
HIGH = CELLS >> 16
VECTOR = "heads binary, lows binary, counts binary"


def pack(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A vector of cells in order and their counts, in few bytes."""
    heads = np.bincount(cells >> 16, minlength=HIGH).astype(np.uint32)
    return heads.tobytes(), (cells & 0xFFFF).astype(np.uint16).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def unpack_cells(heads: bytes, lows: bytes) -> np.ndarray:
    return np.repeat(np.arange(HIGH, dtype=np.int32) << 16, np.frombuffer(heads, np.uint32)) + np.frombuffer(lows, np.uint16)


def unpack_counts(counts: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(counts, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(counts, np.uint32, -1 if len(counts) > n else 0, n if len(counts) > n else 0)
    return out


def unpacked(heads: bytes, lows: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    cells = unpack_cells(heads, lows)
    return cells, unpack_counts(counts, len(cells))


def vectors(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with the vector of ``text``."""
    small_batches(texts.sparkSession)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keep).schema), VECTOR])

    def run(batches):
        import pyarrow as pa

        made = Features()
        for b in batches:
            found = [pack(*made.count(x)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array([x[k] for x in found], pa.binary()) for k in range(3))], [*keep, "heads", "lows", "counts"])

    return texts.select(*keep, "text").mapInArrow(run, schema)


def examples(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id``, ``toxic`` and ``text`` of the bounded sample of labelled documents."""
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    found = documents(docs).join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learnt(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic``, once for each labelled document that isn't held out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many vectors each cell is, and the number of vectors. A task sends each cell once."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            for heads, lows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[unpack_cells(heads, lows)] += 1
            n += b.num_rows
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(total[at[k : k + (1 << 16)]])], ["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["cell", "n"])

    summed = rows.select("heads", "lows").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    cell, n = summed.column("cell").to_numpy(), summed.column("n").to_numpy()
    out = np.zeros(CELLS, np.int64)
    out[cell[cell >= 0]] = n[cell >= 0]
    return out, int(n[cell < 0].sum())


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights at length 1."""
    w = (1 + np.log(counts)) * idf
    return w / math.sqrt(w @ w)


@dataclass
class Sample:
    """The labelled examples as they are sent to workers: example ``k`` has the cells from ``ends[k]`` to ``ends[k + 1]``."""

    ids: np.ndarray
    toxic: np.ndarray
    ends: np.ndarray
    cells: np.ndarray
    counts: np.ndarray
    idf: np.ndarray
    common: int = COMMON
    block: int = BLOCK


class Index:
    """Examples by feature. The lists of rare features are looked at whole: the examples of one are at ``starts[feature]``
    up to the next start in ``example`` and ``weight``. The lists of the most frequent ones are kept by blocks
    of examples, in ``dense``, and ``bound`` has the greatest weight by feature and block."""

    def __init__(self, sample: Sample):
        n, self.block = len(sample.ids), sample.block
        self.idf = sample.idf
        owner = np.repeat(np.arange(n), np.diff(sample.ends))
        own = np.concatenate([np.zeros(0), *(weights(sample.counts[a:b], sample.idf[sample.cells[a:b]]) for a, b in zip(sample.ends[:-1], sample.ends[1:], strict=True) if a < b)])
        cells, feature = np.unique(sample.cells, return_inverse=True)
        order = self._gathered(n, owner, feature, own, self.block)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.n, self.blocks = n, max(1, -(-n // self.block))
        self.ids, self.toxic = sample.ids[order], sample.toxic[order].astype(float)
        times = np.bincount(feature, minlength=len(cells))
        common = np.argsort(-times, kind="stable")[: sample.common]
        number = np.empty(len(cells), np.int64)  # the common features come first
        number[common] = np.arange(len(common))
        number[np.setdiff1d(np.arange(len(cells)), common)] = np.arange(len(common), len(cells))
        self.number = np.full(CELLS, -1, np.int32)
        self.number[cells] = number
        feature = number[feature]
        frequent = feature < len(common)
        self.dense = np.zeros((len(common), self.blocks * self.block))
        self.dense[feature[frequent], place[owner[frequent]]] = own[frequent]
        self.bound = self.dense.reshape(len(common), self.blocks, self.block).max(axis=2)
        feature, owner, own = feature[~frequent], owner[~frequent], own[~frequent]
        by = np.lexsort((place[owner], feature))
        self.example, self.weight = place[owner][by], own[by]
        self.starts = np.searchsorted(feature[by], np.arange(len(cells) + 1))

    @staticmethod
    def _gathered(n: int, owner: np.ndarray, feature: np.ndarray, own: np.ndarray, block: int) -> np.ndarray:
        """An order of the examples in which a block has the ones that are nearest to its first."""
        left, out = np.ones(n, bool), []
        while left.any():
            lead = int(np.flatnonzero(left)[0])
            q = np.zeros(int(feature.max()) + 1 if len(feature) else 1)
            q[feature[owner == lead]] = own[owner == lead]
            near = np.bincount(owner, own * q[feature], minlength=n)
            near[~left], near[lead] = -1, 2
            taken = np.argsort(-near, kind="stable")[: min(block, int(left.sum()))]
            out.append(taken)
            left[taken] = False
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ``k`` examples with the greatest cosines above 0 and these cosines, ties by place; not the
        one with the id in ``but``."""
        total, common = np.zeros((len(vectors), self.blocks * self.block)), np.zeros((len(vectors), len(self.dense)))
        for t, (cells, counts) in enumerate(vectors):
            if not len(cells):
                continue
            at = self.number[cells]
            q = weights(counts, self.idf[cells])
            frequent = (at >= 0) & (at < len(self.dense))
            common[t, at[frequent]] = q[frequent]
            rare = at >= len(self.dense)
            at, q = at[rare], q[rare]
            lo = self.starts[at]
            lengths = self.starts[at + 1] - lo
            places = np.arange(lengths.sum()) + np.repeat(lo - (np.cumsum(lengths) - lengths), lengths)
            total[t] = np.bincount(self.example[places], self.weight[places] * np.repeat(q, lengths), minlength=total.shape[1])
        if but is not None:  # it leaves the index
            own = np.append(self.ids, np.full(total.shape[1] - self.n, -1))[None, :] == np.array(but)[:, None]
        bounds = total.reshape(len(vectors), self.blocks, self.block).max(axis=2) + common @ self.bound
        n_first = min(self.blocks, 1 + -(-k // self.block))
        seen = np.zeros(bounds.shape, bool)
        np.put_along_axis(seen, np.argsort(-bounds, axis=1, kind="stable")[:, :n_first], True, axis=1)
        self._add(total, common, seen)
        if but is not None:
            total[own & np.repeat(seen, self.block, axis=1)] = 0
        found = total.reshape(*bounds.shape, self.block)[seen].reshape(len(vectors), -1)
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.zeros(len(found))
        more = ~seen & (bounds >= least[:, None] - 1e-9)
        self._add(total, common, more)
        if but is not None:
            total[own] = 0
        total[np.repeat(~(seen | more), self.block, axis=1)] = 0
        return [self._top(x, k) for x in np.round(total, 12)]

    def _add(self, total: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """Add the common features' part, where block and text are ``wanted``."""
        for block in range(self.blocks):
            rows = np.flatnonzero(wanted[:, block])
            if len(rows):
                columns = slice(block * self.block, (block + 1) * self.block)
                total[rows, columns] += common[rows] @ self.dense[:, columns]

    @staticmethod
    def _top(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.partition(cosines, -k)[-k] if len(cosines) > k else 0.0
        over = np.flatnonzero(cosines > edge)
        top = np.concatenate([over, np.flatnonzero(cosines == edge)[: k - len(over)]]) if edge > 0 else over
        top = top[np.lexsort((top, -cosines[top]))]
        return top, cosines[top]

    def votes(self, near: tuple[np.ndarray, np.ndarray], numbers: tuple[int, ...]) -> list[float] | None:
        """The share of label 1 among the first neighbours, by their cosines, for each of the ``numbers`` of neighbours."""
        top, cosine = near
        return [float(cosine[:k] @ self.toxic[top[:k]] / cosine[:k].sum()) for k in numbers] if len(top) else None


_built: dict[str, Index] = {}


def _index(key: str, sent) -> Index:
    """This worker's index; made once."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(sent.value)
    return _built[key]


@dataclass
class Curve:
    """A logistic curve over the log odds of the votes of several numbers of neighbours."""

    mean: np.ndarray
    scale: np.ndarray
    slopes: np.ndarray
    shift: float

    @staticmethod
    def odds(votes: np.ndarray) -> np.ndarray:
        return np.log((votes + 0.01) / (1.01 - votes))

    @classmethod
    def fit(cls, votes: np.ndarray, y: np.ndarray, rate: float) -> Curve:
        """By Newton's steps with a slight ridge; the shift is then moved to the ``rate`` of label 1."""
        x = cls.odds(votes)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        ridge = 0.01 * np.diag([1.0] * votes.shape[1] + [1e-6])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        share = y.mean()
        return cls(mean, scale, w[:-1], float(w[-1] + math.log(rate / (1 - rate)) - math.log(share / (1 - share))))

    def score(self, votes: list[float]) -> float:
        z = float((self.odds(np.array(votes)) - self.mean) / self.scale @ self.slopes) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def collect_sample(sample: DataFrame, idf: np.ndarray) -> Sample:
    """The vectors of the examples, in the order of their ids; 2 * EXAMPLES rows at most."""
    rows = sample.toArrow().sort_by("doc_id")
    cells = [unpack_cells(h, x) for h, x in zip(rows.column("heads").to_pylist(), rows.column("lows").to_pylist(), strict=True)]
    counts = [unpack_counts(x, len(c)) for x, c in zip(rows.column("counts").to_pylist(), cells, strict=True)]
    joined = lambda x: np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32)
    return Sample(rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy(), np.cumsum([0, *map(len, cells)]), joined(cells), joined(counts), idf)


def score(docs: DataFrame, labels: DataFrame, numbers: tuple[int, ...] = NEIGHBOURS, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, with the ``evidence``, the ids of the nearest
    examples, and their ``cosines``. ``common`` and ``block`` shape the index and don't change results."""
    spark = docs.sparkSession
    docs = documents(docs)
    known = materialize(learnt(labels), "toxic-labels")
    sample = materialize(vectors(examples(docs, known), "doc_id", "toxic"), "toxic-examples")
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    sizes = {r["toxic"] for r in sample.select("toxic").distinct().collect()}
    rate = counted["toxic"] / counted["n"] if counted["n"] else 0.0
    small_batches(spark)
    if sizes != {0, 1}:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(rate).alias("score"), F.lit(int(rate >= 0.5)).alias("predicted"), F.array().cast("array<long>").alias("evidence"), F.array().cast("array<double>").alias("cosines"))
    rows = materialize(vectors(docs, "doc_id"), "toxic-vectors")
    frequency, n = frequencies(rows)
    made = replace(collect_sample(sample, (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)), common=common, block=block)
    sent, key = spark.sparkContext.broadcast(made), uuid.uuid4().hex  # its size depends on the sample alone

    def own_votes(batches):
        import pyarrow as pa

        index = _index(key, sent)
        for b in batches:
            ids, held = b.column(0).to_pylist(), [unpacked(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            found = [index.votes(x, numbers) for k in range(0, len(ids), TEXTS) for x in index.nearest(held[k : k + TEXTS], max(numbers), ids[k : k + TEXTS])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "votes"])

    dealt = sample.select("doc_id", "toxic", "heads", "lows", "counts").repartition(16, "doc_id")
    voted = dealt.mapInArrow(own_votes, "doc_id long, toxic int, votes array<double>").where("votes is not null").toArrow().sort_by("doc_id")
    votes, y = np.array(voted.column("votes").to_pylist()).reshape(-1, len(numbers)), voted.column("toxic").to_numpy().astype(float)
    curve = Curve.fit(votes, y, rate) if 0 < y.sum() < len(y) else None

    def run(batches):
        import hashlib

        import pyarrow as pa

        index = _index(key, sent)
        seen: dict[bytes, tuple[float, list[int], list[float]]] = {}

        def told(near):
            votes = index.votes(near, numbers)
            p = rate if votes is None or curve is None else curve.score(votes)
            return p, index.ids[near[0][:EVIDENCE]].tolist(), near[1][:EVIDENCE].tolist()

        for b in batches:
            names, new = [], {}
            if len(seen) >= KNOWN_TEXTS:
                seen.clear()
            for packed in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                names.append(hashlib.blake2b(b"".join(packed), digest_size=16).digest())
                if names[-1] not in seen:
                    new[names[-1]] = unpacked(*packed)
            listed = list(new)
            for k in range(0, len(listed), TEXTS):
                some = listed[k : k + TEXTS]
                seen.update(zip(some, map(told, index.nearest([new[x] for x in some], max(numbers))), strict=True))
            out = [seen[x] for x in names]
            columns = [b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([int(x[0] >= 0.5) for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "evidence", "cosines"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>, cosines array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "cosines")
