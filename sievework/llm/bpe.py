"""Byte-level BPE: encoding of distinct words over a prefix trie, and decoding.

A text is cut into words by the vocabulary's pattern; special strings cut first. The distinct words that a worker
hasn't met yet form a trie. A trie node stands for a prefix, and its state is the last token of the prefix's encoding.
A depth-first walk derives a node's state from its ancestors': the one vocabulary entry that ends the prefix and that
the merges would leave standing beside the last token of what precedes it. So words that share a prefix share its
encoding, and a word's ids are read back from its end, last token by last token.

Results for odd input: a null or empty text gives no ids and decodes to the empty text; ids outside the vocabulary
are skipped in decoding, and bytes that aren't UTF-8 decode to U+FFFD. Repeated rows give repeated results. Long texts
are worked through in slices of words, so only their ids are held whole.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from sievework.llm.shared import documents, small_batches

#: The pattern of byte-level BPE vocabularies of this kind: a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words of a generation; a worker keeps two generations.
MAX_WORDS = 400_000
#: Words of a text that are handled at once.
SLICE_WORDS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the merges by rank, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*names.values(), *self.special.values()])
        self.pieces: list[bytes] = [b""] * self.size
        for name, i in names.items():
            self.pieces[i] = name.encode() if name in self.special else bytes(letters[c] for c in name)
        for name, i in self.special.items():
            self.pieces[i] = name.encode()
        self.rank = [-1] * self.size
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made, pair = names[left + right], (names[left], names[right])
            self.merge_rank[pair] = r
            if self.parts[made] is None:
                self.rank[made], self.parts[made] = r, pair
        self.pairs: dict[int, bool] = {}
        self.ids: dict[bytes, int] = {}
        for i in sorted((i for i in names.values() if i not in set(self.special.values())), key=lambda i: self.rank[i]):
            pair = self.parts[i]  # an entry that the merges can't reach is never the result of an encoding
            if pair is None and len(self.pieces[i]) == 1 or pair and all(self.pieces[p] in self.ids for p in pair) and self._unwound(*pair, self.rank[i]):
                self.ids[self.pieces[i]] = i
        self.longest = max(map(len, self.ids))

    def _unwound(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge over the border of ``a`` and ``b`` comes before ``limit``, undoing their latest merges."""
        while True:
            r = self.merge_rank.get((a, b))
            if r is not None and r < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit = self.rank[a]
                a = self.parts[a][1]
            elif self.rank[b] < 0:
                return True
            else:  # of equal merges the left one comes first
                limit = self.rank[b] + 1
                b = self.parts[b][0]

    def beside(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``; remembered by ``a * size + b`` in ``pairs``."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[a * self.size + b] = self._unwound(a, b, float("inf"))
        return found


class Trie:
    """The distinct words as a prefix trie, walked depth-first: the words in sorted order, with the path to the last one.

    For each prefix on the path ``last`` has the last token of its encoding, and ``matched`` which entries of the
    vocabulary end it: the state of an automaton whose states are the prefixes of entries.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.width = [len(x) for x in vocabulary.pieces]
        self.begins = {x[:k] for x in vocabulary.ids for k in range(1, len(x) + 1)} | {b""}
        self.number = {b"": 0}
        self.matches: list[bytes] = [b""]
        self.endings: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}

    def _step(self, key: int) -> int:
        """The state after a state and a byte: the longest ending that an entry begins with."""
        match = self.matches[key >> 8] + bytes([key & 255])
        while match not in self.begins:
            match = match[1:]
        if match not in self.number:
            self.number[match] = len(self.matches)
            self.matches.append(match)
            ids = self.vocabulary.ids
            self.endings.append([(ids[match[k:]], len(match) - k) for k in range(len(match)) if match[k:] in ids])
        found = self.steps[key] = self.number[match]
        return found

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """The words with their ids, in the trie's order. What a word shares with the one before is on the path yet."""
        v, width, steps, endings = self.vocabulary, self.width, self.steps.get, self.endings
        pairs, size, beside, step = v.pairs.get, v.size, v.beside, self._step
        last, matched, previous = [-1], [0], b""
        for word in sorted(words):
            same = 0
            for x, y in zip(word, previous, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], matched[same + 1 :]
            for n in range(same, len(word)):
                key = matched[n] << 8 | word[n]
                state = steps(key)
                if state is None:
                    state = step(key)
                matched.append(state)
                for token, length in endings[state]:
                    if length > n:
                        break
                    left = last[n + 1 - length]
                    fits = pairs(left * size + token)
                    if fits or fits is None and beside(left, token):
                        break
                last.append(token)
            previous, out, n = word, [], len(word)
            while n:
                token = last[n]
                out.append(token)
                n -= width[token]
            out.reverse()
            yield word, tuple(out)


class Codec:
    """Encodes and decodes texts; holds the words met so far. Without ``specials`` special strings are plain text."""

    def __init__(self, path: str, max_words: int = MAX_WORDS, specials: bool = True):
        self.vocabulary = Vocabulary(path)
        self.max_words = max_words
        self.trie = Trie(self.vocabulary)
        self.pattern = regex.compile(WORDS)
        special = self.special = self.vocabulary.special if specials else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self._anew()

    def _anew(self) -> None:
        """Start a generation; the words of the one before it move over as they are met again."""
        self.older: dict[str, tuple[int, ...]] = self.known
        self.known = {}

    def _learn(self, words: set[str]) -> None:
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > self.max_words:
            self._anew()
            fresh = words
        ids, rest, known, older = self.vocabulary.ids.get, {}, self.known, self.older
        for w in fresh:
            if w in older:
                known[w] = older[w]
                continue
            token = ids(b := w.encode())
            if token is not None:
                known[w] = (token,)
            else:
                rest[b] = w
        for b, found in self.trie.walk(rest):
            known[rest[b]] = found

    def _slices(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the id of each special string."""
        special = self.special
        for piece in self.cut.split(text) if self.cut and any(s in text for s in special) else (text,):
            if piece in special:
                yield special[piece]
            elif len(piece) < 5 * SLICE_WORDS:
                yield self.pattern.findall(piece)
            else:
                found = (m.group() for m in self.pattern.finditer(piece))
                while part := list(itertools.islice(found, SLICE_WORDS)):
                    yield part

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; the new words of as many texts as fit a slice are learnt together."""
        held: list[list] = []
        size = 0
        for text in texts:
            if len(text) >= 5 * SLICE_WORDS:
                yield from self._emit(held)
                held, size = [], 0
                ids: array = array("i")
                for part in self._slices(text):
                    for x in self._emit([[part]]):
                        ids.extend(x)
                yield ids
                continue
            held.append(list(self._slices(text)))
            size += len(text)
            if size > 5 * SLICE_WORDS:
                yield from self._emit(held)
                held, size = [], 0
        yield from self._emit(held)

    def _emit(self, held: list[list]) -> Iterator[list[int]]:
        words: set[str] = set()
        for parts in held:
            words.update(*(p for p in parts if not isinstance(p, int)))
        self._learn(words)
        get = self.known.__getitem__
        for parts in held:
            ids: list[int] = []
            for p in parts:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids.extend(itertools.chain.from_iterable(map(get, p)))
            yield ids

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.vocabulary.pieces
        try:
            raw = b"".join(map(pieces.__getitem__, ids))
        except IndexError:
            raw = b"".join(pieces[i] for i in ids if 0 <= i < len(pieces))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, specials: bool = True) -> Codec:
    """One for each Python worker; kept from task to task."""
    return Codec(path, specials=specials)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every text."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(list, codec(path).encode(b.column(1).to_pylist())), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids; null ids count as none."""
    path = vocabulary or default_vocabulary()
    small_batches(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec(path).decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode in one pass over the texts: the number of ids, and digests of ids and decoded text."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        numerals = [str(i) for i in range(c.vocabulary.size)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        gc.freeze()  # the vocabulary and the words hold no cycles; passes over them would find nothing
        gc.disable()
        try:
            for b in batches:
                n, of_ids, of_text = [], [], []
                for ids in c.encode(b.column(1).to_pylist()):
                    n.append(len(ids))
                    of_ids.append(sha(",".join(map(numerals.__getitem__, ids))))
                    of_text.append(sha(c.decode(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
