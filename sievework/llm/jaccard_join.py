"""Near-duplicate classes by an exact Jaccard join on word shingles with adaptive multi-match prefixes.

Two documents link if 100 * intersection >= 75 * union of their shingle sets. Shingles are ordered by the number of
sets that have them, the rarest first. A set of n shingles that links with another shares c = ceil(0.75 n) with it, so
of its first n - c + k shingles at least k are shared. Each document takes the k that costs least by the counts of its
shingles: a longer prefix is met by more documents, but asks for more meetings before a pair is verified. A pair must
meet as often as the smaller k of the two asks for.

1. Sets are hashed, and documents of equal sets become one class (:func:`classes`).
2. Batches of sets are dealt out by ranges of shingles. There, shingles of one set alone are dropped; they can't be
   shared (:func:`_owners`). A shingle that is frequent within a batch isn't sent to one place: its owners go straight
   on, and only a mark goes to the range, after which it counts as frequent everywhere and comes last in the order.
   What counts as frequent falls with the number of batches, so one shingle never fills a range (:func:`_often`).
   Ranges are dealt in ``PASSES`` passes over the texts, and only the shared shingles of a pass are kept, so that not all
   shingles are on disk at once.
3. Dealt out by document, the shared shingles show which documents have 75 % of theirs shared at all; only these go on,
   with their prefixes (:func:`_candidates`).
4. Of each shingle's documents the one whose shingles are the most common leads. Each document is verified against the
   leader that it meets most. These links join most copies of a large group at a cost in proportion to its size.
5. Shingles whose documents are in different components yet connect regions (:func:`_regions`). A region's documents
   meet in blocks of bounded size, every two of its blocks in one group (:func:`_meet`). A region of more than
   ``MOST_BLOCKS`` blocks isn't met as a whole: its documents meet by the first document of each shared shingle, or,
   where even these are too many, by the shingle itself (:func:`_blocks`). Documents that meet often enough and aren't
   joined yet are verified; what comes out is a link for each joining of components, not each pair. Components of all
   links are the result.

Results for odd input: a null or empty text has no shingles and its own id as component; a null ``doc_id`` is linked
with nothing and has a null component; repeated rows have equal sets, so they fall into one class; rows that share a
``doc_id`` count as one document in links. An empty table gives an empty result. Sets are compared by 64-bit hashes; texts are read whole.

The documents should come from stored files, as sets are numbered by their place in a split: a split that is read again
in another pass, or after a loss, has to give its rows in the same order.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import discard, documents, materialize, small_batches
from sievework.llm.shingles import mix, shingles
from sievework.operators.components import components

PERCENT = 75
#: Shingles that a worker holds before it deals them out, and about how many a range of them has.
BATCH_SHINGLES = 1_000_000
#: Passes over the texts in which ranges of shingles are dealt out.
PASSES = 2
#: Sets of a batch with a shingle from which on the shingle counts as frequent everywhere; less with very many batches.
FREQUENT = 64
#: The number of a shingle's sets goes on as a byte, this many steps to each doubling; the last one is for frequent ones.
STEPS, FREQUENT_STEP = 8, 255
#: Shingles of a block of documents.
BLOCK_SHINGLES = 1_000_000
#: The most blocks whose documents meet two by two only because they are of one region.
MOST_BLOCKS = 16
#: The most meetings asked for, and the cost of a verification in shingles met.
MOST_MEETINGS, VERIFY_COST = 8, 64

DEALT = "bucket int, kind int, base long, steps binary, wide binary, low binary, high binary, tokens binary, docs binary, sizes binary"
OWNED = "bucket int, refs binary, tokens binary, frequencies binary, docs binary, sizes binary"
CANDIDATE = "doc_id long, n long, meetings int, common double, tokens binary, prefix array<long>"
MET = "a long, b long"


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and the ``digest`` of the set."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [shingles(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, found), pa.int64()), pa.array(map(_digest, found), pa.binary())], ["doc_id", "n_shingles", "digest"])

    return documents(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def classes(rows: DataFrame) -> DataFrame:
    """``digest`` and ``representative``: the smallest ``doc_id`` with that set."""
    return rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("representative"))


def _ranges(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64), len(x))


def _narrow(owner: np.ndarray) -> dict[str, bytes]:
    """Rising numbers as bytes of their differences; those of 255 and more are apart, in order."""
    steps = np.diff(owner, prepend=0)
    return {"steps": np.minimum(steps, 255).astype(np.uint8).tobytes(), "wide": steps[steps >= 255].astype(np.uint32).tobytes()}


def _widen(steps: bytes, wide: bytes) -> np.ndarray:
    out = np.frombuffer(steps, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(wide, np.uint32)
    return np.cumsum(out)


def _schema(ddl: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _often(n_batches: int) -> int:
    """Sets of a batch from which on a shingle is frequent. A shingle under that in every batch brings a range at most
    as many references as a batch has shingles, or one for each batch where there are more batches than that."""
    return max(2, min(FREQUENT, BATCH_SHINGLES // n_batches))


def _deal(docs: DataFrame, n_ranges: int, turn_of: int = 0, passes: int = 1) -> DataFrame:
    """Shingles of the ranges of pass ``turn_of``; batches' documents in the first. Batches are the same in each pass."""
    frequent_from = _often(n_ranges)

    def flush(held: list[tuple[int, np.ndarray]], base: int, turn: int):
        """Rows of kind 0: shingles of a range with their sets; 1: frequent shingles of a range; 2: frequent shingles
        with their sets; 3: the documents of the batch's sets. Sets are numbered from ``base``."""
        arrays = [s for _, s in held]
        sizes = np.array([len(s) for s in arrays], dtype=np.uint32)
        tokens, owner = np.concatenate(arrays), np.repeat(np.arange(len(held)), sizes)
        bucket = _ranges(tokens, n_ranges)
        if passes > 1:
            own = bucket * passes // n_ranges == turn_of
            tokens, owner, bucket = tokens[own], owner[own], bucket[own]
        order = np.argsort(tokens, kind="stable")
        starts = _runs(tokens[order])
        times = np.diff(starts)
        often = np.zeros(len(tokens), dtype=bool)
        often[order] = np.repeat(times >= frequent_from, times)
        if turn_of == 0:
            yield {"bucket": turn % n_ranges, "kind": 3, "base": base, "docs": np.array([d for d, _ in held], dtype=np.int64).tobytes(), "sizes": sizes.tobytes()}
        plain = np.flatnonzero(~often)
        plain = plain[np.argsort(bucket[plain], kind="stable")]  # by range, and within it by set
        edges = _runs(bucket[plain])
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            at = plain[x:y]
            yield {"bucket": int(bucket[at[0]]), "kind": 0, "base": base, "low": tokens[at].astype(np.uint32).tobytes(), "high": (tokens[at] >> np.uint64(32)).astype(np.uint32).tobytes()} | _narrow(owner[at])
        frequent = np.flatnonzero(often)
        if len(frequent):
            first = order[starts[:-1][times >= frequent_from]]
            for b in np.unique(bucket[first]):
                yield {"bucket": int(b), "kind": 1, "base": base, "tokens": tokens[first[bucket[first] == b]].tobytes()}
            for k, at in enumerate(np.array_split(frequent, 1 + len(frequent) // 100_000)):
                yield {"bucket": (turn + k) % n_ranges, "kind": 2, "base": base, "tokens": tokens[at].tobytes()} | _narrow(owner[at])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema, part = _schema(DEALT), TaskContext.get().partitionId()
        held: list[tuple[int, np.ndarray]] = []
        at: dict[bytes, int] = {}
        size = turn = 0

        def send():
            rows = []
            for r in flush(held, (part << 40) + (turn << 20), part * 7919 + turn):
                rows.append(r)
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s):
                    continue
                d = _digest(s)
                if d in at:  # of equal sets in a batch the first document's goes on
                    held[at[d]] = (min(doc, held[at[d]][0]), s)
                    continue
                at[d] = len(held)
                held.append((doc, s))
                size += len(s)
                if size >= BATCH_SHINGLES:
                    yield from send()
                    held, at, size, turn = [], {}, 0, turn + 1
        if held:
            yield from send()

    return documents(docs).where("doc_id is not null").mapInArrow(run, DEALT)


def _read(table, column: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=dtype) for x in table.column(column).to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, dtype=dtype)


def _refs(table) -> np.ndarray:
    parts = [base + _widen(s, w) for base, s, w in zip(*(table.column(c).to_pylist() for c in ("base", "steps", "wide")), strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _owners(n_parts: int):
    """For a range of shingles: the shared ones with the number of their sets, dealt out by set; batches' documents are
    dealt out likewise."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = table.column("kind")
        plain, marks, passed, listed = (table.filter(pc.equal(kinds, k)) for k in range(4))
        tokens = _read(plain, "low", np.uint32).astype(np.uint64) | _read(plain, "high", np.uint32).astype(np.uint64) << np.uint64(32)
        refs = _refs(plain)
        order = np.argsort(tokens, kind="stable")
        tokens, refs = tokens[order], refs[order]
        times = np.diff(_runs(tokens))
        steps = np.minimum(np.round(np.log2(times) * STEPS), FREQUENT_STEP - 1) if len(times) else times
        often = np.isin(tokens, _read(marks, "tokens", np.uint64))
        frequency = np.where(often, FREQUENT_STEP, np.repeat(steps, times)).astype(np.uint8)
        shared = frequency > 0
        tokens, refs, frequency = tokens[shared], refs[shared], frequency[shared]
        more = _read(passed, "tokens", np.uint64)
        tokens, refs = np.append(tokens, more), np.append(refs, _refs(passed))
        frequency = np.append(frequency, np.full(len(more), FREQUENT_STEP, dtype=np.uint8))
        rows = []
        for at in _by_part(refs, n_parts):
            rows.append({"bucket": _part(refs[at[0]], n_parts), "refs": refs[at].tobytes(), "tokens": tokens[at].tobytes(), "frequencies": frequency[at].tobytes()})
        for base, docs, sizes in zip(*(listed.column(c).to_pylist() for c in ("base", "docs", "sizes")), strict=True):
            docs, sizes = np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.uint32)
            numbers = base + np.arange(len(docs))
            for at in _by_part(numbers, n_parts):
                rows.append({"bucket": _part(numbers[at[0]], n_parts), "refs": numbers[at].tobytes(), "docs": docs[at].tobytes(), "sizes": sizes[at].tobytes()})
        return pa.Table.from_pylist(rows, _schema(OWNED))

    return run


def _part(ref, n_parts: int) -> int:
    return int(_ranges(mix(np.array([ref]).astype(np.uint64)), n_parts)[0])


def _by_part(refs: np.ndarray, n_parts: int) -> list[np.ndarray]:
    """The places of ``refs`` by part, each in the order of the numbers."""
    part = _ranges(mix(refs.astype(np.uint64)), n_parts)
    order = np.lexsort((refs, part))
    edges = _runs(part[order])
    return [order[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


def prefix(frequencies: np.ndarray, n: int) -> tuple[int, int]:
    """Of a set's shared shingles in order: how many its prefix takes, and how many meetings it asks for.

    The shingles that no other set has come before them and take up room in the prefix.
    """
    least = -(-PERCENT * n // 100)
    alone = n - len(frequencies)
    met = np.append(0.0, np.cumsum(2.0 ** (frequencies / STEPS)))
    k = np.arange(1, min(MOST_MEETINGS, least) + 1)
    ends = np.clip(n - least + k - alone, 0, len(frequencies))
    best = int(np.argmin(met[ends] * (1 + VERIFY_COST / k)))
    return int(ends[best]), int(k[best])


def _candidates(table):
    """For a part of the sets: those with enough shared shingles, their shingles and their prefixes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    listed = pc.is_valid(table.column("docs"))
    own, found = table.filter(listed), table.filter(pc.invert(listed))
    numbers, docs, sizes = _read(own, "refs", np.int64), _read(own, "docs", np.int64), _read(own, "sizes", np.uint32)
    order = np.argsort(numbers)
    numbers, docs, sizes = numbers[order], docs[order], sizes[order]
    refs, tokens, frequencies = _read(found, "refs", np.int64), _read(found, "tokens", np.uint64), _read(found, "frequencies", np.uint8)
    order = np.lexsort((tokens, frequencies, refs))
    refs, tokens, frequencies = refs[order], tokens[order], frequencies[order]
    begins = _runs(refs)
    rows = []
    for x, y in zip(begins[:-1], begins[1:], strict=True):
        at = np.searchsorted(numbers, refs[x])
        n = int(sizes[at])
        if 100 * (y - x) < PERCENT * n:
            continue
        end, meetings = prefix(frequencies[x:y], n)
        if end:
            rows.append({"doc_id": int(docs[at]), "n": n, "meetings": meetings, "common": float(frequencies[x:y].sum(dtype=np.int64) / STEPS / n), "tokens": np.sort(tokens[x:y]).tobytes(), "prefix": tokens[x : x + end].view(np.int64)})
    return pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("meetings", pa.int32()), ("common", pa.float64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))]))


def candidates(docs: DataFrame, n_shingles: int) -> DataFrame:
    """Documents that may link, one for each set of a batch, with the shared shingles and the prefix of each, stored."""
    n = max(1, -(-n_shingles // BATCH_SHINGLES))
    small_batches(docs.sparkSession)
    passes, owned = min(PASSES, n), None
    for k in range(passes):
        shared = materialize(_deal(docs, n, k, passes).groupBy("bucket").applyInArrow(_owners(n), OWNED), "owned")
        owned = shared if owned is None else owned.unionByName(shared)
    found = materialize(owned.groupBy("bucket").applyInArrow(_candidates, CANDIDATE), "candidates")
    discard(owned)
    return found


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of the pairs ``a``, ``b`` those that link."""
    side = lambda c: found.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}"))

    def run(batches):
        import pyarrow as pa

        for x in batches:
            t = x.to_pydict()
            links = []
            for na, nb, ta, tb in zip(t["n_a"], t["n_b"], t["tokens_a"], t["tokens_b"], strict=True):
                both = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                links.append(100 * both >= PERCENT * (na + nb - both))
            yield pa.RecordBatch.from_pydict({"a": x.column(x.schema.get_field_index("a")), "b": x.column(x.schema.get_field_index("b"))}).filter(pa.array(links, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _regions(open_: DataFrame) -> DataFrame:
    """``doc_id`` and ``region``: documents that shingles of ``open_`` connect."""
    lead = open_.groupBy("token").agg(F.min("doc_id").alias("b"))
    edges = open_.join(lead, "token").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    return components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("region"))


def _meet(table):
    """Links that join components among the documents of a block, or of two blocks."""
    import pyarrow as pa

    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, n, meetings = ids[order], table.column("n").to_numpy()[order], table.column("meetings").to_numpy()[order]
    tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").take(pa.array(order)).to_pylist()]
    prefixes = [np.array(x, dtype=np.int64).view(np.uint64) for x in table.column("prefix").take(pa.array(order)).to_pylist()]
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            joined[x] = joined.get(joined[x], joined[x])
            x = joined[x]
        return x

    component = table.column("component").to_numpy()[order].copy()
    met, shared = _Postings(prefixes), _Postings(tokens)
    links = []
    for q in range(len(ids)):
        times = met.count(prefixes[q], len(ids))
        times[: q + 1] = 0
        near = np.flatnonzero((times > 0) & (times >= np.minimum(meetings, meetings[q])) & (component != component[q]) & (100 * np.minimum(n, n[q]) >= PERCENT * np.maximum(n, n[q])))
        near = near[[top(component[x]) != top(component[q]) for x in near]] if len(near) else near
        if not len(near):
            continue
        both = shared.count(tokens[q], len(ids))[near]
        for x in near[100 * both >= PERCENT * (n[near] + n[q] - both)]:
            a, b = top(component[x]), top(component[q])
            if a != b:
                joined[max(a, b)] = min(a, b)
                links.append((int(ids[q]), int(ids[x])))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


class _Postings:
    """The documents of each shingle that two or more of them have."""

    def __init__(self, arrays: list[np.ndarray]):
        values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        self.starts = _runs(values)
        self.values = values[self.starts[:-1]]

    def count(self, wanted: np.ndarray, size: int) -> np.ndarray:
        """For each document how many of the ``wanted`` it has; these are all within the postings."""
        at = np.searchsorted(self.values, wanted)
        hits = [self.owner[x:y] for x, y in zip(self.starts[at], self.starts[at + 1], strict=True) if y - x > 1]
        return np.bincount(np.concatenate(hits), minlength=size) if hits else np.zeros(size, dtype=np.int64)


def _blocks(open_: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``open_`` once for each group that they meet in: ``level``, ``key``, ``x``, ``y``.

    Any two documents that share an open shingle are in one group at least. Keys are regions; of regions with more than
    ``MOST_BLOCKS`` blocks, the first documents of shingles; of such documents with too many blocks, the shingles. Small
    keys share groups. A larger one is cut into blocks by a hash, and a document goes to a group for each block, its own
    included. So a document is copied ``MOST_BLOCKS`` times at most for its region, and beyond that for what it meets.
    """
    first = open_.groupBy("token").agg(F.min("doc_id").alias("first"))
    sized = found.groupBy("doc_id").agg(F.sum(F.length("tokens") / 8).cast("long").alias("size"))
    rest = open_.select("token", "doc_id", "component").join(_regions(open_.select("token", "doc_id")), "doc_id").join(sized, "doc_id").join(first, "token")
    rest = materialize(rest, "open-sized")
    placed = None
    for level, key in enumerate(("region", "first", "token")):
        own = rest.select(F.lit(level).alias("level"), F.col(key).alias("key"), "doc_id", "component", "size").distinct()
        sizes = materialize(own.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks")), "block-sizes")
        met = own.join(sizes.where(F.col("blocks") <= MOST_BLOCKS) if key != "token" else sizes, "key")
        placed = met if placed is None else placed.unionByName(met)
        large = sizes.where(F.col("blocks") > MOST_BLOCKS).select(F.col("key").alias(key))
        if key == "token" or large.isEmpty():
            break
        rest = rest.join(large, key, "left_semi")
    placed = materialize(placed, "placed")
    total = placed.where("blocks <= 1").agg(F.sum("size").alias("n")).first()["n"] or 0
    bins = max(1, -(-total // BLOCK_SHINGLES))
    few = placed.where("blocks <= 1").withColumns({"key": F.pmod(F.xxhash64("level", "key"), F.lit(bins)), "level": F.lit(-1), "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    many = placed.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("own", "other")
    dealt = few.unionByName(many).select("level", "key", "x", "y", "doc_id", "component").distinct()
    return dealt.join(found.drop("common"), "doc_id")


def links(found: DataFrame) -> DataFrame:
    """Links between documents of different sets, enough of them for the components to be those of all links."""
    met = found.select("doc_id", "common", F.explode("prefix").alias("token"))
    lead = met.groupBy("token").agg(F.max(F.struct("common", (-F.col("doc_id")).alias("order"))).alias("lead"), F.count(F.lit(1)).alias("owners")).where("owners > 1").select("token", (-F.col("lead.order")).alias("lead"))
    shared = met.drop("common").join(lead, "token")
    toward = shared.where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.count(F.lit(1)).alias("times"))
    most = toward.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("lead")).alias("order"))).alias("best"))
    star = materialize(verify(most.select(F.col("doc_id").alias("a"), (-F.col("best.order")).alias("b")), found), "star-links")
    known = components(star).withColumnRenamed("node", "doc_id")
    placed = shared.drop("lead").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialize(placed, "meetings")
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    open_ = materialize(placed.join(mixed, "token", "left_semi"), "open")
    rest = _blocks(open_, found).groupBy("level", "key", "x", "y").applyInArrow(_meet, MET)
    return star.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    rows = materialize(sets(docs), "shingle-sets")
    total = rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    found = candidates(docs, total)
    joined = components(links(found)).select(F.col("node").alias("representative"), "component")
    grouped = classes(rows).join(joined, "representative", "left").select("digest", F.coalesce("component", "representative").alias("component_id"))
    placed = rows.join(grouped, "digest", "left")
    alone = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", alone.alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
k AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS k FROM w WHERE len(a) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(a, k, k + 4), ' ') AS sh FROM k), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 75 * (x.n + y.n - c)), b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
t(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.doc_id, b.j FROM t JOIN b ON b.i = t.seen)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""
