"""Language-model scores by prediction by partial matching over bytes (operator 1).

The model is the trie of all byte contexts of up to ORDER bytes in the training texts, with the count of each byte that follows.
A byte is coded in the longest context that has been seen; where it is new there, an escape (method D: each distinct byte seen
gives half a count to it) leads to the context one byte shorter, in which the bytes of the longer one are excluded. Texts are read with A-Z in
lower case, with ORDER start marks before and one end mark after. The marks are bytes that UTF-8 never uses.

Nothing of the model is held whole anywhere but its first two levels (256 x 256 counts). Texts are dealt into blocks of about
BLOCK_BYTES. A block asks for the code length of each of its distinct grams (ORDER bytes and the next one); a byte's code length
depends on its gram alone. Grams are dealt by the last two bytes of their context (their suffix), so all longer contexts that end
alike meet, with their training counts from all blocks, and answer; a suffix of many grams is cut by the byte before, so that no
cell holds many and no part of the model is sent twice but the counts after the suffix itself (256 numbers). Words for the base
score go the same way, dealt by hash. Both answers return to the blocks, which add up their texts. So every exchange is per block and
distinct gram, none per byte of the corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table, texts_of

#: Bytes of context; at most 5, as a gram without its suffix has 4 bytes.
ORDER = 5
BLOCK_BYTES = 8 << 20
#: Bytes of text that are scored at a time.
SCORE_BYTES = 1 << 20
START, END = 0xFE, 0xFF
ALPHABET = 255  # all bytes but START
#: Blocks whose words of one bucket meet, about, and the fewest buckets.
BLOCKS_A_BUCKET, LEAST_BUCKETS = 4, 64
#: Grams of a suffix, from all blocks, beyond which it is cut by the byte before.
PIECE_GRAMS = 1 << 21
_STAGE = "block long, kind int, key int, n int, a binary, b binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of each text and its end mark, and where each text starts in them.

    A gram is written as the last two bytes of its context (its suffix), the bytes before them, then the next byte.
    """
    mark = bytes([START]) * ORDER
    flat = np.frombuffer(b"".join(x for t in texts for x in (mark, t, b"\xff")), np.uint8)
    n = max(0, len(flat) - ORDER)
    code = np.zeros(n, np.uint64)
    for i in (ORDER - 2, ORDER - 1, *range(ORDER - 2), ORDER):
        code <<= np.uint64(8)
        code |= flat[i : n + i]
    return code[flat[ORDER:] != START], np.cumsum([0] + [len(t) + 1 for t in texts])


REST_BITS = np.uint64(8 * (ORDER - 1))


def in_order(suffix: int, rest: np.ndarray) -> np.ndarray:
    """Grams of one suffix with their bytes in the order of the text, from what follows the suffix in grams_of()."""
    rest = rest.astype(np.uint64)
    return (rest >> np.uint64(8)) << np.uint64(24) | np.uint64(suffix << 8) | (rest & np.uint64(0xFF))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return (spot, keys[spot] == wanted) if len(keys) else (np.zeros(len(wanted), int), np.zeros(len(wanted), bool))


class Level:
    """Counts of (context, symbol) in contexts of one length, and of the contexts themselves."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, below: Level | None):
        self.pairs, self.counts = pairs, counts.astype(np.float64)
        context = pairs >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(pairs) else np.zeros(0, int)
        self.contexts = context[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.distinct = np.diff(np.append(first, len(pairs))).astype(np.float64)
        self.below = below
        self.excluded = np.zeros(len(first))  # what the shorter context has counted of the symbols seen here

    def exclude(self, shorter: Level, bits: int) -> Level:
        """Fills `excluded` by the counts of the level one byte shorter, whose contexts have so many bits."""
        if len(self.pairs):
            short = ((self.pairs >> np.uint64(8)) & np.uint64((1 << bits) - 1)) << np.uint64(8) | (self.pairs & np.uint64(0xFF))
            spot, there = _find(shorter.pairs, short)
            amount = np.where(there, shorter.counts[spot] if len(shorter.counts) else 0, 0.0)
            index = np.searchsorted(self.contexts, self.pairs >> np.uint64(8))
            self.excluded = np.bincount(index, amount, len(self.contexts))
        return self


def levels_of(grams: np.ndarray, counts: np.ndarray, lowest: int) -> list[Level]:
    """Levels of context length lowest..ORDER from training grams and their counts; each has what it excludes in the next shorter,
    but the lowest, whose shorter level lies elsewhere."""
    out = []
    for k in range(lowest, ORDER + 1):
        pairs, n = summed(grams & np.uint64((1 << 8 * (k + 1)) - 1), counts)
        out.append(Level(pairs, n, out[-1] if out else None))
    for k in range(1, len(out)):
        out[k].exclude(out[k - 1], 8 * (lowest + k - 1))
    return out


def code_lengths(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each gram after the bytes before it; levels[k] has contexts of k bytes."""
    logp = np.zeros(len(grams))
    todo = np.arange(len(grams))
    gone = np.zeros(len(grams))  # how many distinct symbols, and how much of this level's count, the longer contexts have excluded
    cut = np.zeros(len(grams))
    for k in range(len(levels) - 1, -1, -1):
        level, g = levels[k], grams[todo]
        pair = g & np.uint64((1 << 8 * (k + 1)) - 1)
        spot, seen = _find(level.contexts, pair >> np.uint64(8))
        total = np.where(seen, level.total[spot] if len(level.total) else 0, 0.0) - cut[todo]
        distinct = np.where(seen, level.distinct[spot] if len(level.distinct) else 0, 0.0) - gone[todo]
        live = seen & (distinct > 0)
        at, hit = _find(level.pairs, pair)
        hit &= live
        count = np.where(hit, level.counts[at] if len(level.counts) else 0, 0.0)
        both = np.where(live, 2 * total, 1.0)
        logp[todo] += np.log10(np.where(hit, 2 * count - 1, np.where(live, distinct, 1.0)) / both)
        all_gone = np.where(seen, level.distinct[spot] if len(level.distinct) else 0, 0.0)
        gone[todo] = np.where(seen, all_gone, gone[todo])
        if k:
            cut[todo] = np.where(seen, level.excluded[spot] if len(level.excluded) else 0, 0.0)
        todo = todo[~hit]
    logp[todo] -= np.log10(np.maximum(1, ALPHABET - gone[todo]))
    return logp


def squeeze(numbers: np.ndarray, rising: bool = False) -> bytes:
    """uint32 numbers as compressed bytes, by byte place; rising ones by their differences."""
    own = np.diff(numbers, prepend=np.uint32(0)) if rising else numbers
    return zlib.compress(own.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def expand(data: bytes, rising: bool = False) -> np.ndarray:
    own = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(own, dtype=np.uint32) if rising else own


def _pack(words: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 1)


def _unpack(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b"\n")


def _blocks(docs: DataFrame, word_buckets: int) -> DataFrame:
    """Texts gathered into blocks (kind 0), their distinct grams by suffix (1, with their number) and words by bucket (2), with
    training counts."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [x.split()[0] for x in _STAGE.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def block_rows(block: int, ids: list, texts: list[bytes]):
        train = np.array([not held_out(d) for d in ids])
        head = struct.pack("<q", len(ids)) + b"".join(struct.pack("<qBq", d or 0, d is None, len(t)) for d, t in zip(ids, texts))
        yield block, 0, 0, 0, head, zlib.compress(b"".join(texts), 1)
        code, starts = grams_of(texts)
        code <<= np.uint64(1)
        code |= np.repeat(train, np.diff(starts)).astype(np.uint8)
        code.sort()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        flagged, n = code[first], np.diff(np.append(first, len(code)))
        del code
        trains = (flagged & np.uint64(1)).astype(bool)
        every = flagged >> np.uint64(1)
        last = np.concatenate((every[1:] != every[:-1], [True]))  # a gram's row with training counts, if any, is its last
        counts = np.where(trains, n, 0).astype(np.uint32)[last]
        every = every[last]
        suffix, rest = every >> REST_BITS, (every & np.uint64((1 << int(REST_BITS)) - 1)).astype(np.uint32)
        edge = np.flatnonzero(np.concatenate(([True], suffix[1:] != suffix[:-1], [True])))
        for a, b in zip(edge[:-1], edge[1:]):
            yield block, 1, int(suffix[a]), int(b - a), squeeze(rest[a:b], True), squeeze(counts[a:b])
        words: Counter = Counter()
        seen: set = set()
        for t, own in zip(texts, train):
            w = t.split()
            if own:
                words.update(w)
            else:
                seen.update(w)
        for w in seen:
            words.setdefault(w, 0)
        buckets: dict[int, list] = {}
        for w, c in words.items():
            buckets.setdefault(zlib.crc32(w) % word_buckets, []).append((w, c))
        for k, own in buckets.items():
            own.sort()
            yield block, 2, k, len(own), _pack([w for w, _ in own]), squeeze(np.array([c for _, c in own], np.uint32))

    def run(batches):
        part, serial, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def emit():
            rows, size = [], 0
            for row in block_rows((part << 24) + serial, ids, texts):
                rows.append(row)
                size += len(row[4]) + len(row[5])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode().lower()
                ids.append(d), texts.append(raw)
                held += len(raw) + 1
                if held >= BLOCK_BYTES:
                    yield from emit()
                    ids, texts, held = [], [], 0
                    serial += 1
        if ids:
            yield from emit()

    bounded_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, _STAGE)


def _answer_words(stage: DataFrame) -> DataFrame:
    """(block, kind 4, key, a: counts of the block's words in all training texts, n: the bucket's tokens, v: its distinct words)."""
    import pyarrow as pa

    schema = "block long, kind int, key int, a binary, n long, v long"
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(rows: pa.Table) -> pa.Table:
        total: Counter = Counter()
        asked = []
        for block, words, counts in zip(rows["block"].to_pylist(), rows["a"].to_pylist(), rows["b"].to_pylist()):
            words = _unpack(words)
            asked.append((block, words))
            for w, c in zip(words, expand(counts).tolist()):
                if c:
                    total[w] += c
        n, v, key = sum(total.values()), len(total), rows["key"][0].as_py()
        get = total.get
        out = [(block, 4, key, zlib.compress(np.array([get(w, 0) for w in words], np.uint64).tobytes(), 1), n if i == 0 else 0, v if i == 0 else 0) for i, (block, words) in enumerate(asked)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return stage.where("kind = 2").groupBy("key").applyInArrow(answer, schema)


def pieces_by_suffix(stage: DataFrame) -> dict[int, int]:
    """How many pieces each suffix is cut into, where it is more than one; at most 65,536 numbers."""
    sizes = stage.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > PIECE_GRAMS).collect()
    return {r.key: min(256, -(-r.n // PIECE_GRAMS)) for r in sizes}


def piece_of(rest: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of each gram of a suffix, by the byte before the suffix."""
    return (rest >> np.uint32(8) & np.uint32(0xFF)) % np.uint32(pieces)


def _cut(stage: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """(key, piece, block, a, b): the grams of each block by suffix and piece."""
    import pyarrow as pa

    schema = "key int, piece int, block long, a binary, b binary"
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        for batch in batches:
            out = []
            for key, block, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key not in cuts:
                    out.append((key, 0, block, a, b))
                    continue
                rest, n = expand(a, True), expand(b)
                piece = piece_of(rest, cuts[key])
                for p in np.unique(piece).tolist():
                    own = piece == p
                    out.append((key, p, block, squeeze(rest[own], True), squeeze(n[own])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return stage.where("kind = 1").select("key", "block", "a", "b").mapInArrow(run, schema)


def _gram_counts(cells: DataFrame) -> DataFrame:
    """(key, piece, a: grams, b: uint64 counts): training counts of all blocks added up, by suffix and piece, a run of blocks at a time."""
    import pyarrow as pa

    schema = "key int, piece int, a binary, b binary"

    def run(batches):
        cell, grams, counts, held = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), []

        def merge():
            nonlocal grams, counts, held
            if held:
                grams, counts = summed(np.concatenate([grams, *(g for g, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
                held = []

        def row():
            merge()
            own = [pa.array([cell[0]], pa.int32()), pa.array([cell[1]], pa.int32()), pa.array([grams.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(own, names=["key", "piece", "a", "b"])

        for b in batches:
            for k, p, a, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (k, p) != cell:
                    if cell is not None:
                        yield row()
                    cell, grams, counts = (k, p), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
                n = expand(c)
                learnt = n > 0
                held.append((in_order(k, expand(a, True)[learnt]), n[learnt].astype(np.uint64)))
                if len(held) >= 32:
                    merge()
        if cell is not None:
            yield row()

    return cells.select("key", "piece", "a", "b").repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(run, schema)


def _after_suffix(counts: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """(key, piece, a): the counts of each byte after a suffix, 256 numbers, for each of its pieces."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [np.bincount((np.frombuffer(a, np.uint64) & np.uint64(0xFF)).astype(np.int64), np.frombuffer(n, np.uint64).astype(np.float64), 256) for a, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["key", "a"])

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(a))
        out = [(k, p, zlib.compress(n.tobytes(), 1)) for k, n in sums.items() for p in range(cuts.get(k, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()))], names=["key", "piece", "a"])

    return counts.select("key", "a", "b").mapInArrow(run, "key int, a binary").repartition("key").mapInArrow(add_up, "key int, piece int, a binary")


def _short_levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (one byte of context, next byte), 256 x 256 numbers, and their sums by next byte."""
    import pyarrow as pa

    def run(batches):
        table = np.zeros(65536, np.int64)
        for b in batches:
            for a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.frombuffer(a, np.uint64)
                table += np.bincount((g & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(n, np.uint64).astype(np.float64), 65536).astype(np.int64)
        there = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(table[there])], names=["pair", "n"])

    got = counts.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 256 * 256
    pairs = np.array(sorted(r.pair for r in got), np.uint64)
    by = {r.pair: r.n for r in got}
    return pairs, np.array([by[int(p)] for p in pairs], np.int64)


def _answer_grams(cells: DataFrame, counts: DataFrame, cuts: dict[int, int], short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(block, kind 3, key, piece, a: float32 code lengths of the block's grams of that suffix and piece)."""
    import pyarrow as pa

    schema = "block long, kind int, key int, piece int, a binary"
    none = F.lit(None).cast("binary").alias("b")
    no_block = F.lit(None).cast("long").alias("block")
    rows = _after_suffix(counts, cuts).select("key", "piece", F.lit(0).alias("turn"), no_block, "a", none)
    rows = rows.union(counts.select("key", "piece", F.lit(1).alias("turn"), no_block, "a", "b"))
    rows = rows.union(cells.select("key", "piece", F.lit(2).alias("turn"), "block", "a", none))

    def run(batches):
        pairs, n = short
        one = Level(pairs, n, None)
        zero = Level(*summed(pairs & np.uint64(0xFF), n), None)
        one.exclude(zero, 0)
        two, levels = None, [zero, one]
        for b in batches:
            out = []
            for key, piece, turn, block, a, c in zip(*(b.column(i).to_pylist() for i in range(6))):
                if turn == 0:
                    after = np.frombuffer(zlib.decompress(a))
                    seen = np.flatnonzero(after)
                    two = Level(np.uint64(key << 8) | seen.astype(np.uint64), after[seen], one).exclude(one, 8)
                elif turn == 1:
                    long = levels_of(np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64), 3)
                    long[0].exclude(two, 16)
                    levels = [zero, one, two, *long]
                else:
                    out.append((block, 3, key, piece, code_lengths(in_order(key, expand(a, True)), levels).astype(np.float32).tobytes()))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "turn").mapInArrow(run, schema)


def _add_up(rows, cuts: dict[int, int]):
    """For one block: its texts' scores, from the code lengths of its grams and the counts of its words."""
    import pyarrow as pa

    ids, nulls, texts = [], [], []
    costs: dict[tuple[int, int], np.ndarray] = {}
    counts: dict[int, np.ndarray] = {}
    own: dict[int, list[bytes]] = {}
    asked: dict[int, bytes] = {}
    for kind, key, piece, a, b in zip(*(rows[c].to_pylist() for c in ("kind", "key", "piece", "a", "b"))):
        if kind == 0:
            (n,) = struct.unpack_from("<q", a)
            flat, at = zlib.decompress(b), 0
            for d, null, size in struct.iter_unpack("<qBq", a[8:]):
                ids.append(None if null else d), texts.append(flat[at : at + size])
                at += size
        elif kind == 2:
            own[key] = _unpack(a)
        elif kind == 1:
            asked[key] = a
        elif kind == 3:
            costs[key, piece] = np.frombuffer(a, np.float32)
        elif kind == 4:
            counts[key] = np.frombuffer(zlib.decompress(a), np.uint64)
    every, cost = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for k in sorted(asked):
        rest = expand(asked[k], True)
        every.append(np.uint64(k) << REST_BITS | rest.astype(np.uint64))
        if k in cuts:
            piece, each = piece_of(rest, cuts[k]), np.zeros(len(rest))
            for p in np.unique(piece).tolist():
                each[piece == p] = costs[k, p]
            cost.append(each)
        else:
            cost.append(costs[k, 0].astype(np.float64))
    every, cost = np.concatenate(every), np.concatenate(cost)
    score = []
    first = 0
    while first < len(texts):  # some texts at a time
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= SCORE_BYTES:
            size += len(texts[last])
            last += 1
        code, starts = grams_of(texts[first:last])
        mine, index = np.unique(code, return_inverse=True)
        score.append(np.add.reduceat(cost[np.searchsorted(every, mine)][index], starts[:-1]))
        first = last
    score = np.concatenate(score) if score else np.zeros(0)
    known = {w: np.log10(c + 1) for k, words in own.items() for w, c in zip(words, counts[k].tolist()) if c}
    base, n_tokens, n_known = [], [], []
    for t in texts:
        words = t.split()
        found = [known[w] for w in words if w in known]
        base.append(float(np.sum(found)) if found else 0.0), n_tokens.append(len(words) + 1), n_known.append(len(found))
    out = [pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids]), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score)]
    return pa.Table.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base_log", "score"])


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Training texts are those whose crc32 of the doc_id, as text, modulo 7 is not 2 (a null doc_id is the empty text, and trains).
    score is the model's log10 probability of the lower-cased text and its end; base_score that of its words and end by add-one
    unigrams. A null text is empty: it is its end. Repeated rows train and score as often as they occur. Without any training
    text all bytes are equally likely. Extra columns are ignored; an empty table gives an empty result.
    """
    size = texts_of(docs).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    stage = materialize(_blocks(docs, max(LEAST_BUCKETS, size // BLOCK_BYTES // BLOCKS_A_BUCKET)), "ppm-blocks")
    cuts = pieces_by_suffix(stage)
    cells = _cut(stage, cuts)
    counts = materialize(_gram_counts(cells), "ppm-counts")
    grams = materialize(_answer_grams(cells, counts, cuts, _short_levels(counts)), "ppm-grams")
    discard(counts)
    words = materialize(_answer_words(stage), "ppm-words")
    trained = texts_of(docs).where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2).count()
    row = words.agg(F.sum("n"), F.sum("v")).first()
    n, v = (row[0] or 0) + trained, (row[1] or 0) + (trained > 0)
    none = F.lit(None).cast("binary").alias("b")
    whole = F.lit(0).alias("piece")
    parts = stage.select("block", "kind", "key", whole, "a", F.when(F.col("kind") == 0, F.col("b")).alias("b"))
    parts = parts.union(grams.select("block", "kind", "key", "piece", "a", none)).union(words.select("block", "kind", "key", whole, "a", none))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"
    sums = parts.groupBy("block").applyInArrow(lambda rows: _add_up(rows, cuts), schema)
    end = F.log10(F.lit(float(trained + 1)))
    base = F.col("base_log") + end - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(trained > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
