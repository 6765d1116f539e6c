"""BPE, chat formatting and packing against the tokenizers library."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import bpe, chat, packing, registry

ODD = ["", " ", None, "x<|endoftext|>  y <|endoftext|>", "a" * 5000, "日本語 😀😀 ‍", "\x1c\x1d a\x85b\u180e", "aaa aaaa" * 30, "\n\n \t x\r\n", "don't I'll WE'VE 'S", "  lead", "trail  ", "é" * 99, "1234567890 ½²"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def table(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, piece long").repartition(2)


def test_every_code_point(tokenizer):
    texts = ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    c = bpe.Codec(bpe.default_vocabulary())
    got = [list(x) for x in c.encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [c.decode(x) for x in got] == texts


def test_random_words_and_small_generations(tokenizer):
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu'é0 ") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(60)]
    c = bpe.Codec(bpe.default_vocabulary(), max_words=200)
    assert [list(x) for x in c.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_text_goes_in_slices(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_WORDS", 10)
    text = "some words, more words; 12 and <|endoftext|> the rest of it " * 5
    c = bpe.Codec(bpe.default_vocabulary())
    assert [list(x) for x in c.encode(["ab", text, ""])] == [e.ids for e in tokenizer.encode_batch(["ab", text, ""], add_special_tokens=False)]


def test_decode_odd_ids():
    c = bpe.Codec(bpe.default_vocabulary())
    assert c.decode([]) == "" and c.decode([10**6, 15496]) == "Hello"
    assert c.decode([c.vocabulary.ids[b"\xff"]]) == "\ufffd"


def test_round_trip_query(spark, tokenizer):
    docs = table(spark, ODD + ODD[:3])
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for k, t in enumerate(ODD + ODD[:3]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(texts[k] == (t or "") for k, t in enumerate(ODD))
    assert bpe.round_trip(docs.where("doc_id < 0")).count() == 0


def test_bpe_over_the_table(spark, tokenizer):
    got = {r.doc_id: r.ids_sha256 for r in registry.op1_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, tokenizer.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "### ", "\\### Assistant: </turn> ok", "a: b", "</turn>\n", "<|endoftext|>", "\\n"])
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert "\n</turn>" not in "\n" + escaped and not escaped.startswith("### ")
    t = chat.template(bpe.default_vocabulary())
    ids, lengths, in_loss = t.format([("assistant", text)])[0]
    assert (ids >= t.begin).sum() == 3 and 50256 not in ids
    role, back, loss, n = t.read(ids, t.mask(lengths, in_loss))
    assert (role, back, loss or "") == ("assistant", text, text) and n == len(chat.BEGIN + "assistant" + chat.COLON + escaped + chat.END)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "é\n"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "n")]
    got = {r.conv_id: r for r in chat.chat_digests(chat.with_escape_case(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\nassistant\nb\nassistant\né\n\n"), 3, sha("bé\n"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars, got[2].loss_sha256) == (2, sha("\nx\n\nx\n"), 0, sha(""))
    assert got[None].loss_chars == 1
    text = "\\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_sha256) == (2, sha(f"user\n{text}\nassistant\n{text}\n"), sha(text))
    none = chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0


def packed(plan, counts):
    found = defaultdict(list)
    for x, (firsts, sequences, offsets) in plan.runs.items():
        for k, first in enumerate(firsts):
            end = firsts[k + 1] if k + 1 < len(firsts) else counts[x]
            for r in range(first, end):
                found[sequences[k] + r - first].append((offsets[k], x))
    return found


@pytest.mark.parametrize("capacity", [1, 5, 16, 100, 2048])
def test_plans(capacity):
    rng = random.Random(capacity)
    for _ in range(6):
        counts: dict[int, int] = {}
        for _ in range(rng.randint(0, 3000)):
            x = min(capacity, max(1, int(rng.expovariate(2.5 / capacity))))
            counts[x] = counts.get(x, 0) + rng.choice([1, 1, 50])
        plan = packing.plan(dict(counts), capacity)
        found = packed(plan, counts)
        assert sum(map(len, found.values())) == sum(counts.values()) and len(found) == plan.sequences
        for pieces in found.values():
            at = 0
            for offset, x in sorted(pieces):
                assert offset == at
                at += x
            assert at <= capacity
        least = -(-sum(x * n for x, n in counts.items()) // capacity)
        assert least <= plan.sequences <= least + max(2, least // 50)


def test_sum_index_finds_whatever_brute_force_does():
    rng = random.Random(2)
    for _ in range(60):
        stock = np.array([0, *(rng.choice([0, 0, 0, 1, 2]) for _ in range(30))])
        index = packing.SumIndex(stock)
        for _ in range(25):
            taken, gap = rng.randrange(1, 31), rng.randrange(1, 31)
            if not stock[taken]:
                continue
            left = stock.copy()
            left[taken] -= 1
            lengths = [x for x in range(31) for _ in range(left[x])]
            some = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(lengths, k))
            found = index.find(gap, taken)
            assert (found is not None) == some
            if found:
                assert sum(found) == gap and all(left[x] >= found.count(x) for x in found)
                for x in (taken, *found):
                    stock[x] -= 1  # the index follows the stock


def test_packing_query(spark, tokenizer):
    texts = [*ODD, " " * 1_100_000 + "a", "word " * 5000, "q" * 3000, *(f"text number {k} " * k for k in range(40)), *ODD]
    rows = packing.pack(table(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(table(spark, ["a"]).where("false")).count() == 0


def test_encode_clashing_columns(spark):
    assert bpe.encode(table(spark, ["a b"])).columns == ["doc_id", "ids"]
    assert packing.pieces(table(spark, ["a b"])).select(F.sum("length")).first()[0] == 3
