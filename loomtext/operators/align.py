"""Alignment of an edited source with its earlier version, so that finished work is kept."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the largest table of a gap that is compared exactly.
MOST_CELLS = 1_000_000


def rising(xs: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    length = []
    for x in xs:
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        length.append(k + 1)
    out, want, below = [], len(tails), None
    for i in range(len(xs) - 1, -1, -1):
        if length[i] == want and (below is None or xs[i] < below):
            out.append(i)
            want, below = want - 1, xs[i]
    return out[::-1]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many codes a and b have in common from the start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _exact(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence. rest[i, j] is its length for a[i:] and b[j:], filled a row at a time: a row is the running
    maximum of what the row below gives. Of equal ways the one that passes over a text of a is taken."""
    rest = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best = np.maximum(rest[i + 1, :-1], (rest[i + 1, 1:] + 1) * (b == a[i]))
        rest[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while rest[i, j]:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rest[i + 1, j] == rest[i, j]:
            i += 1
        else:
            j += 1
    return out


def _next_copies(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Each code of b with its first copy in a after the one that was taken last, where there is one."""
    copies = {int(x): np.flatnonzero(a == x) for x in np.intersect1d(a, b)}
    out, free = [], 0
    for j, x in enumerate(b.tolist()):
        later = copies.get(x, np.zeros(0, int))
        k = int(np.searchsorted(later, free))
        if k < len(later):
            out.append((int(later[k]), j))
            free = int(later[k]) + 1
    return out


def _single(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur once in x, and where."""
    codes, first, n = np.unique(x, return_index=True, return_counts=True)
    return codes[n == 1], first[n == 1]


def _within(a: np.ndarray, b: np.ndarray, most_cells: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Pairs of one stretch, and the stretches (of a, of b) between them that are to be looked at again."""
    head = _alike(a, b)
    tail = _alike(a[head:][::-1], b[head:][::-1])
    pairs = [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return pairs, []
    (mine, at_a), (theirs, at_b) = _single(a), _single(b)
    _, x, y = np.intersect1d(mine, theirs, return_indices=True)
    order = np.argsort(at_b[y])
    left, right = at_a[x][order].tolist(), at_b[y][order].tolist()
    chain = [(left[k], right[k]) for k in rising(left)]
    if not chain:
        find = _exact if len(a) * len(b) <= most_cells else _next_copies
        return pairs + [(head + i, head + j) for i, j in find(a, b)], []
    edges = [(-1, -1), *chain, (len(a), len(b))]
    between = [(head + i + 1, head + k, head + j + 1, head + m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return pairs + [(head + i, head + j) for i, j in chain], [z for z in between if z[0] < z[1] and z[2] < z[3]]


def align(old: list[str], new: list[str], most_cells: int = MOST_CELLS) -> list[int | None]:
    """For each new text the old one it matches, in order: ends first, then texts that are unique on both sides, then the stretches
    between, all of them at a time."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(t, len(codes)) for t in x], np.int64) for x in (old, new))
    match: list[int | None] = [None] * len(new)
    stretches = [(0, len(a), 0, len(b))]
    while stretches:
        after = []
        for i, k, j, m in stretches:
            pairs, rest = _within(a[i:k], b[j:m], most_cells)
            for x, y in pairs:
                match[j + y] = i + x
            after += [(i + p, i + q, j + r, j + t) for p, q, r, t in rest]
        stretches = after
    return match


def moved(old: list[str], new: list[str], match: list[int | None]) -> list[int | None]:
    """match, with the n-th new copy of a text that is left over taking the n-th old copy that is."""
    taken = {m for m in match if m is not None}
    n_old, n_new = Counter(), Counter()
    spare = {}
    for i, text in enumerate(old):
        if i not in taken:
            spare[text, n_old[text]] = i
            n_old[text] += 1
    out = []
    for text, m in zip(new, match):
        if m is None:
            m = spare.get((text, n_new[text]))
            n_new[text] += 1
        out.append(m)
    return out


def moved_blocks(old: DataFrame, new: DataFrame, aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, new_blk, old_blk): of what an alignment (key, new_blk, old_blk) left over, the n-th copy of a text with the n-th, as an
    equal join; for alignments that are tables. align_blocks() does the same within a document."""
    used = aligned.where("old_blk is not null")
    left = lambda df, blk: df.join(used.select(key, F.col(blk).alias("blk")), [key, "blk"], "left_anti")
    return match_leftovers(left(old, "old_blk"), left(new, "new_blk"), key)


def align_blocks(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, new_blk, old_blk): each new block with the old block it matches in order or, moved, by its text; or null. Both have (key,
    blk, text); a document is one group, as alignment needs all of it; old documents without a new version give nothing."""
    import pandas as pd

    def one(before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        before, after = before.sort_values("blk"), after.sort_values("blk")
        texts = before["text"].tolist(), after["text"].tolist()
        old_at = before["blk"].tolist()
        found = [None if m is None else old_at[m] for m in moved(*texts, align(*texts))]
        return pd.DataFrame({key: after[key].tolist(), "new_blk": after["blk"].tolist(), "old_blk": pd.array(found, dtype="Int64")})

    cols = [key, "blk", "text"]
    kind = dict(new.dtypes)[key]
    return old.select(cols).groupBy(key).cogroup(new.select(cols).groupBy(key)).applyInPandas(one, f"{key} {kind}, new_blk long, old_blk long")


def match_leftovers(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, new_blk, old_blk): the n-th copy of a text on one side with the n-th on the other, as an equal join."""
    place = Window.partitionBy(key, "text").orderBy("blk")
    n = lambda df, name: df.select(key, "text", F.col("blk").alias(name), F.row_number().over(place).alias("_n"))
    return n(old, "old_blk").join(n(new, "new_blk"), [key, "text", "_n"]).select(key, "new_blk", "old_blk")


def carried(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts (keys, blk, part, old_text, text, state, final) with `kept`: only blocks of which every part carries."""
    own = (F.col("old_text") == F.col("text")) & F.col("state").isin("done", "flagged") & F.col("final").isNotNull()
    block = Window.partitionBy(*keys, "blk")
    return parts.withColumn("kept", F.bool_and(F.coalesce(own, F.lit(False))).over(block))


def runs(items: DataFrame, keys: list[str], order: str, origin: str) -> DataFrame:
    """items with `run`: a number that goes up wherever `origin` (null: new) changes along the order."""
    along = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(along) == 1
    change = first | ~F.col(origin).eqNullSafe(F.lag(origin).over(along))
    return items.withColumn("_c", change.cast("int")).withColumn("run", F.sum("_c").over(along)).drop("_c")


def refreshed(new: DataFrame, old: DataFrame, aligned: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, blk, text, tokens, old_blk, from_chunk, chunk, state, final): the chunk list of a source after it changed.

    new has (key, blk, text, tokens), old (key, blk, text, chunk, state, final), aligned (key, new_blk, old_blk). A block whose text is that of its
    old block, in a finished chunk with a final text, keeps it; blocks that follow one another out of one old chunk stay a chunk with its
    state. The gaps between are packed anew, pending. Chunks are numbered through in order.
    """
    from .plan import pack

    matched = aligned.where("old_blk is not null").select(key, F.col("new_blk").alias("blk"), "old_blk")
    was = old.select(key, F.col("blk").alias("old_blk"), F.col("text").alias("_text"), F.col("chunk").alias("_chunk"), F.col("state").alias("_state"), F.col("final").alias("_final"))
    items = new.select(key, "blk", "text", "tokens").join(matched, [key, "blk"], "left").join(was, [key, "old_blk"], "left")
    keeps = (F.col("text") == F.col("_text")) & F.col("_state").isin("done", "flagged") & F.col("_final").isNotNull()
    items = items.withColumn("from_chunk", F.when(keeps, F.col("_chunk"))).withColumn("final", F.when(keeps, F.col("_final"))).withColumn("state", F.when(keeps, F.col("_state")).otherwise("pending"))
    items = runs(items.drop("_text", "_chunk", "_state", "_final"), [key], "blk", "from_chunk")
    fresh = pack(items.where("from_chunk is null"), [key, "run"], "blk", budget).withColumnRenamed("chunk", "_in")
    both = items.where("from_chunk is not null").withColumn("_in", F.lit(1)).unionByName(fresh)
    return both.withColumn("chunk", F.dense_rank().over(Window.partitionBy(key).orderBy("run", "_in"))).select(key, "blk", "text", "tokens", "old_blk", "from_chunk", "chunk", "state", "final")


def refresh_report(after: DataFrame, old: DataFrame, aligned: DataFrame, key: str) -> DataFrame:
    """(key, kept, to_translate, removed, chunks, chunks_kept, edits_kept, edits_dropped) of what refreshed() gave; old has `edited`."""
    here = after.groupBy(key).agg(F.count("from_chunk").alias("kept"), F.count(F.when(F.col("from_chunk").isNull(), 1)).alias("to_translate"), F.max("chunk").alias("chunks"), F.countDistinct(F.when(F.col("from_chunk").isNotNull(), F.col("chunk"))).alias("chunks_kept"))
    carried_ = after.where("from_chunk is not null").select(key, F.col("old_blk").alias("blk"), F.lit(1).alias("_carried"))
    matched = aligned.where("old_blk is not null").select(key, F.col("old_blk").alias("blk"), F.lit(1).alias("_matched")).distinct()
    mine = F.coalesce(F.col("edited"), F.lit(False)) & F.col("final").isNotNull()
    before = old.join(carried_, [key, "blk"], "left").join(matched, [key, "blk"], "left").groupBy(key).agg(
        F.count(F.when(F.col("_matched").isNull(), 1)).alias("removed"), F.count(F.when(mine & F.col("_carried").isNotNull(), 1)).alias("edits_kept"), F.count(F.when(mine & F.col("_carried").isNull(), 1)).alias("edits_dropped")
    )
    return before.join(here, key, "full").select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "to_translate", "removed", "chunks", "chunks_kept", "edits_kept", "edits_dropped")))
