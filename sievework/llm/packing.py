"""Best-fit packing of token sequences by exact-complement hashing.

A document's ids, with an end id, are cut into pieces of at most the capacity; only a longer document is cut, and its
first piece takes what its length leaves over. Packing is planned on the number of pieces of each length, so the plan's
size depends on the capacity and not on the corpus. From the longest length down, the gap beside a piece is looked up in
an index of the single lengths and of the sums of two and three lengths in stock, and as many bins are closed at once
as the stock of the rarest length in the combination allows; the index follows the stock. What finds no exact complement is packed best-fit
decreasing, also by counts. Each piece then gets its rank among the pieces of its length, and the plan turns the rank
into a sequence and an offset. Ranks are formed within hashed parts of a length, so a length that holds most pieces
isn't sorted by one task.

Results for odd input: a null or empty text is a piece of the end id alone; repeated rows are packed like others; an
empty table gives an empty result. Ties between pieces of one length are broken by a hash of the id, then the id.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.bpe import WORDS, byte_letters, codec, default_vocabulary
from sievework.llm.shared import documents, materialize, small_batches

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that are ranked together, about.
PART_ROWS = 100_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a text to its ids: the vocabulary in a fast library where that ranks merges as the file does, and
    this package's codec for other vocabularies and for texts that the library's pattern gives up on."""
    import json

    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = spec["model"]["vocab"]
    merged = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    plain = lambda text: list(next(iter(codec(path).encode([text]))))
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return plain
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in name): i for name, i in names.items() if name not in special}
    fast = tiktoken.Encoding("pieces", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern ran out of room, as on very long runs of spaces
            return plain(text)

    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encode = _encoder(path)
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text), dtype="<u4")
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                first = len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    for column, x in zip(out, (doc, k, start, end - start, zlib.crc32(ids[start:end])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Plan:
    """Per length, runs of ranks: the first rank, the sequence of that rank, and the offset that all of the run share."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


class SumIndex:
    """Which lengths in stock sum to a gap: one, two or three of them.

    For each sum the index holds the greatest length that the stock can still complete. Stock only falls, so these places
    only move down, and each step is taken once for a whole plan, whatever the number of gaps.
    """

    def __init__(self, stock: np.ndarray):
        self.stock = stock
        sums = np.arange(len(stock))
        self.pairs, self.triples = sums - 1, sums - 2  # the greatest lengths that a sum of two or three can have

    def _two(self, total: int, x: int, taken: tuple[int, ...]) -> bool:
        """Whether ``x`` and its complement are in stock beside what is ``taken``."""
        y = total - x
        return all(self.stock[z] >= (x, y, *taken).count(z) for z in (x, y))

    def pair(self, total: int, top: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of ``top`` at most, the greater one first."""
        if total < 2:
            return None
        least = (total + 1) // 2
        while self.pairs[total] >= least and not self._two(total, int(self.pairs[total]), ()):
            self.pairs[total] -= 1
        for x in range(min(int(self.pairs[total]), top), least - 1, -1):
            if self.stock[x] and self._two(total, x, taken):
                return x, total - x
        return None

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, int, int] | None:
        if total < 3:
            return None
        least = (total + 2) // 3
        while self.triples[total] >= least and (not self.stock[self.triples[total]] or not self.pair(total - int(self.triples[total]), int(self.triples[total]), (int(self.triples[total]),))):
            self.triples[total] -= 1
        for x in range(int(self.triples[total]), least - 1, -1):
            if self.stock[x] > taken.count(x) and (two := self.pair(total - x, x, (*taken, x))):
                return x, *two
        return None

    def find(self, gap: int, taken: int) -> tuple[int, ...] | None:
        """Lengths that exactly fill the gap beside a piece of the length ``taken``."""
        if gap < len(self.stock) and self.stock[gap] > (gap == taken):
            return (gap,)
        return self.pair(gap, gap - 1, (taken,)) or self.triple(gap, (taken,))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` pieces by length into sequences."""
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        stock[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = [((capacity,), int(stock[capacity]))]
    stock[capacity] = 0
    index = SumIndex(stock)
    for a in range(capacity - 1, 0, -1):
        while stock[a]:
            found = index.find(capacity - a, a)
            if not found:
                break
            uses: dict[int, int] = defaultdict(int)
            for x in (a, *found):
                uses[x] += 1
            n = min(int(stock[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                stock[x] -= n * k
            patterns.append(((a, *found), n))
    bins: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, number]
    for a in range(capacity, 0, -1):
        left = int(stock[a])
        while left:
            gap = min((g for g, held in bins.items() if g >= a and held), default=None)
            if gap is None:
                each = capacity // a
                for lengths, n in (((a,) * each, left // each), ((a,) * (left % each), 1 if left % each else 0)):
                    if n:
                        bins[capacity - sum(lengths)].append([lengths, n])
                left = 0
            else:
                lengths, n = bins[gap].pop()
                k = min(n, left)
                if n > k:
                    bins[gap].append([lengths, n - k])
                bins[gap - a].append([(*lengths, a), k])
                left -= k
    patterns += [(lengths, n) for held in bins.values() for lengths, n in held]
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths if n else ():
            runs[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return Plan({x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()}, sequence)


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``cut`` with ``rank``: 0, 1, ... among the rows of each length, of which ``counts`` has the numbers.

    A length has as many parts as its number asks for, so that a part stays small however many pieces have one length.
    """
    of_length = cut.sparkSession.createDataFrame([(x, -(-n // PART_ROWS)) for x, n in counts.items()], "length long, parts long")  # capacity rows at most
    parts = cut.join(F.broadcast(of_length), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    counted = parts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for PART_ROWS pieces, and one for each length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    return parts.withColumn("rank", within - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    cut = materialize(pieces(docs, capacity, end_id, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    made = plan(counts, capacity)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                firsts, sequences, offsets = made.runs[int(x)]
                run = np.searchsorted(firsts, rank[rows], side="right") - 1
                sequence[rows] = sequences[run] + rank[rows] - firsts[run]
                offset[rows] = offsets[run]
            kept = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(cut, counts).select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
