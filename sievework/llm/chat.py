"""Chat formatting by token-level assembly.

A turn is a begin mark, the role, a colon mark, the text and an end mark. The marks are reserved ids past the
vocabulary's and no text can encode to them: segments are encoded apart, and special strings in them as plain text.
In the rendered form the marks are control strings, so a backslash is put before every control string and backslash
within a role or text, which makes the rendered form reversible as well. Segment lengths give the places of segments by
prefix sums, and the loss mask covers the texts of assistant turns alone.

Results for odd input: a null role or text counts as empty; turns of one number are ordered by role, then text; a null
``turn`` comes first and a null ``conv_id`` is a conversation; repeated rows are repeated turns; an empty table gives no
rows but those of the fixed conversation that the query adds.

Turns are formatted and read back where they lie. A conversation's digests are formed over its sorted turns one by one,
so a conversation of any length takes no more memory than a batch.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bpe import codec, default_vocabulary
from sievework.llm.shared import small_batches

BEGIN, COLON, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>|: ")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"

TURNS = "conv_id long, turn long, role string, text string, ids array<int>, lengths array<int>, in_loss array<boolean>"
READ = "conv_id long, turn long, role string, text string, loss string, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m.group(1), text)


class Template:
    """Formats turns as ids and reads them back."""

    def __init__(self, path: str):
        self.codec = codec(path, specials=False)  # the strings of special tokens are plain text here
        first = self.codec.vocabulary.size
        self.marks = {first: BEGIN, first + 1: COLON, first + 2: END}
        self.begin, self.colon, self.end = self.marks

    def format(self, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each turn the ids, the lengths of its five segments, and which of the segments count for the loss."""
        encoded = list(self.codec.encode([escape(x) for turn in turns for x in turn]))
        out = []
        for k, (role, _) in enumerate(turns):
            segments = [[self.begin], encoded[2 * k], [self.colon], encoded[2 * k + 1], [self.end]]
            lengths = np.array([len(x) for x in segments])
            out.append((np.array([i for x in segments for i in x], dtype=np.int32), lengths, np.array([False, False, False, role == LOSS_ROLE, False])))
        return out

    @staticmethod
    def mask(lengths: np.ndarray, in_loss: np.ndarray) -> np.ndarray:
        """The loss mask of a turn's ids: +1 where a segment that counts begins and -1 where it ends, summed up."""
        ends = np.cumsum(lengths)
        steps = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        np.add.at(steps, (ends - lengths)[in_loss], 1)
        np.add.at(steps, ends[in_loss], -1)
        return np.cumsum(steps)[:-1] > 0

    def decode(self, ids: np.ndarray) -> str:
        return self.codec.decode(ids.tolist())

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None, int]:
        """Role, text, the text under the mask (None without any) and the number of characters of the rendered turn."""
        at = np.flatnonzero(ids >= self.begin)
        if ids[at].tolist() != [self.begin, self.colon, self.end] or at[0] != 0 or at[2] != len(ids) - 1:
            raise ValueError("not one turn")
        spans = slice(1, at[1]), slice(at[1] + 1, at[2])
        role, text = (self.decode(ids[x]) for x in spans)
        under = [x for x, span in ((role, spans[0]), (text, spans[1])) if mask[span].any()]
        if int(mask.sum()) != sum(int(x.stop - x.start) for x in spans if mask[x].any()):
            raise ValueError("the mask cuts a segment")
        return unescape(role), unescape(text), unescape("".join(under)) if under else None, len(BEGIN + role + COLON + text + END)


@lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def format_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each turn with its ``ids``, the ``lengths`` of its segments and which are ``in_loss``."""
    path = vocabulary or default_vocabulary()
    small_batches(conversations.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = template(path).format(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)))
            columns = [pa.array([x[k] for x in made], t) for k, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "ids", "lengths", "in_loss"])

    return _turns(conversations).mapInArrow(run, TURNS)


def read_turns(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Roles, texts and loss texts as the ids have them."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            t = template(path)
            rows = []
            for ids, lengths, in_loss in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                rows.append(t.read(np.array(ids, dtype=np.int32), t.mask(np.array(lengths), np.array(in_loss, dtype=bool))))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", "turn", "role", "text", "loss", "formatted_chars"])

    return formatted.select("conv_id", "turn", "ids", "lengths", "in_loss").mapInArrow(run, READ)


def round_trip(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each turn formatted and read back from its ids and mask, in one pass."""
    path = vocabulary or default_vocabulary()
    small_batches(conversations.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            t = template(path)
            formatted = t.format(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)))
            rows = [t.read(ids, t.mask(lengths, in_loss)) for ids, lengths, in_loss in formatted]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], ["conv_id", "turn", "role", "text", "loss", "formatted_chars"])

    return _turns(conversations).mapInArrow(run, READ)


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation, formed over its turns in order."""

    def run(batches):
        import pyarrow as pa

        nothing = object()
        held, n, chars, formatted, turns, loss = nothing, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for b in batches:
            rows = []
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "loss", "formatted_chars")]
            for conv, role, text, under, length in zip(*columns, strict=True):
                if conv != held:
                    if held is not nothing:
                        rows.append((held, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
                    held, n, chars, formatted, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n += 1
                formatted += length
                turns.update(f"{role}\n{text}\n".encode())
                if under is not None:
                    chars += len(under)
                    loss.update(under.encode())
            yield _digest_batch(rows, pa)
        if held is not nothing:
            yield _digest_batch([(held, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)], pa)

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, DIGESTS)


def _digest_batch(rows, pa):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def with_escape_case(conversations: DataFrame) -> DataFrame:
    """The turns with conversation -7, whose texts hold a backslash and control strings."""
    spark = conversations.sparkSession
    text = "\\### Assistant: </turn> ok"
    case = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return _turns(conversations).unionByName(case)


def chat_digests(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return digests(round_trip(conversations, vocabulary))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>|: )', '\\\1', 'g')) + 14 AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
