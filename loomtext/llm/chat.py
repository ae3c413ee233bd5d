"""Chat formatting with offset-aligned loss masks (operator 8).

A conversation is rendered as one string: each turn is OPEN role MIDDLE text CLOSE. The three marks are single tokens of their
own. In roles and texts a backslash is written twice and one is put inside any mark or other control string, so that no mark can
occur there, and the unescaped text comes back exactly. The string is encoded once, with the offsets of every token; the loss
mask is the intersection of the assistants' text spans, sorted, with the token spans, by binary search. As marks cut the string
before any merge, spans and tokens meet at the same borders.

Turns come to a task sorted by conversation and turn and are taken in runs, so a conversation may be of any length: a run ends
at a turn's border once it holds RUN_CHARS, and encoding runs one after the other gives the same tokens as encoding all at once.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "</turn>"
ASSISTANT = "assistant"
RUN_CHARS = 200_000
#: A backslash, or the first character of something that could be read as a mark, a special token or a role heading.
_CONTROL = re.compile(r"\\|<(?=\|)|<(?=/turn>)|#(?=##)")
_ESCAPED = re.compile(r"\\(.)", re.S)
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
#: The conversation that the contract adds.
PROBE = r"\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string, and the (start, end) of each assistant's escaped text in it, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        out += (head, body, CLOSE)
        if role == ASSISTANT and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The public tokenizer with the three marks as tokens of their own, after its vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.post_processor = ByteLevel(trim_offsets=False)  # a space before a word belongs to its token
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (OPEN, MIDDLE, CLOSE)])
    return t


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token lies in a span; both lists are sorted, so each span finds its tokens by binary search."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask = [False] * len(offsets)
    for a, b in spans:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        mask[first:last] = [True] * (last - first)
    return mask


def formatted(turns: list[tuple[str, str]], path: str) -> tuple[list[int], list[bool], int]:
    """Token ids, loss mask and length of the string."""
    text, spans = render(turns)
    e = chat_tokenizer(path).encode(text, add_special_tokens=False)
    return e.ids, loss_mask(e.offsets, spans), len(text)


def read_turns(ids: list[int], path: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, from token ids alone."""
    text = chat_tokenizer(path).decode(ids, skip_special_tokens=False)
    out = []
    for turn in text.split(OPEN)[1:]:
        role, _, body = turn[: -len(CLOSE)].partition(MIDDLE)
        out.append((unescape(role), unescape(body)))
    return out


def read_loss(ids: list[int], mask: list[bool], path: str) -> list[str]:
    """Each maximal run of masked tokens as unescaped text."""
    t, out, run = chat_tokenizer(path), [], []
    for i, m in zip([*ids, 0], [*mask, False]):
        if m:
            run.append(i)
        elif run:
            out.append(unescape(t.decode(run, skip_special_tokens=False)))
            run = []
    return out


class _Digest:
    """What is read back from the formatted runs of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.n_loss = 0

    def add(self, turns: list[tuple[str, str]], path: str) -> None:
        ids, mask, chars = formatted(turns, path)
        for role, text in read_turns(ids, path):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for text in read_loss(ids, mask, path):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += chars
        self.n_tokens += len(ids)
        self.n_loss += sum(mask)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.n_loss


def formats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each conv_id, read back from its tokens: SCHEMA.

    Turns go by turn; equal turns by role, then text; null turns first. A null role or text is empty. Rows with a null conv_id are
    one conversation without id. Repeated rows are turns as often as they occur. Extra columns are ignored; an empty table gives
    no row.
    """
    import pyarrow as pa

    path = path or tokenizer_path(TOKENIZER)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string() if "string" in x else pa.int64() for x in SCHEMA.split(", ")]
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        nothing = object()
        conv, digest, held, size, out = nothing, None, [], 0, []

        def flush():
            nonlocal held, size
            if held:
                digest.add(held, path)
            held, size = [], 0

        for b in batches:
            for k, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if conv is nothing or k != conv:
                    if conv is not nothing:
                        flush()
                        out.append((conv, *digest.row()))
                    conv, digest = k, _Digest()
                held.append((role, text))
                size += len(text)
                if size >= RUN_CHARS:
                    flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                out = []
        if conv is not nothing:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip((conv, *digest.row())), kinds)], names=names)

    bounded_batches(conversations.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose turns look like control strings."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, ASSISTANT, PROBE)], "conv_id long, turn long, role string, text string")
    return formats(own.union(probe))
