"""Benchmark decontamination by greedy string tiling (operator 5).

A benchmark item and a document are lists of lower-cased words. Seeds, windows of MIN_MATCH words, join the two: a document meets
only the items with which it shares a window. For such a pair, running Karp-Rabin matching finds the longest common runs of words
that nothing covers yet, marks them, and goes on with shorter ones down to MIN_MATCH, so moved and reordered passages count as
well. The share of the item's words under tiles decides. Every tile consists of seed windows, so only the document's stretches of
seeds are searched, which loses nothing.

The items go to the tasks in parts of at most PART_BYTES of text; a larger benchmark takes more than one pass over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, texts_of

MIN_MATCH, THRESHOLD = 5, 0.5
PART_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _matches(p, t, p_mark, t_mark, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in p, start in t) of at least s unmarked words, found by rolling hashes of s words."""

    def windows(x, mark):
        power = pow(_BASE, s, _MOD)
        h = run = 0
        for i, w in enumerate(x):
            if mark[i]:
                h = run = 0
                continue
            h = (h * _BASE + w) % _MOD
            run += 1
            if run > s:
                h = (h - x[i - s] * power) % _MOD
            if run >= s:
                yield i - s + 1, h

    table = defaultdict(list)
    for i, h in windows(p, p_mark):
        table[h].append(i)
    out = []
    for j, h in windows(t, t_mark):
        for i in table.get(h, ()):
            if i and j and not p_mark[i - 1] and not t_mark[j - 1] and p[i - 1] == t[j - 1]:
                continue  # not maximal: a run that starts earlier holds it
            k = 0
            while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not p_mark[i + k] and not t_mark[j + k]:
                k += 1
            if k >= s:
                out.append((k, i, j))
    return out


def tiles(p: list[int], t: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of p by t: (length, start in p, start in t), longest first, none overlapping in p or in t.

    Words of t that are 0 match nothing. Ties go to the earliest place in p, then in t.
    """
    p_mark, t_mark = [False] * len(p), [w == 0 for w in t]
    out, s = [], max(least, len(p))
    while True:
        queue = [(-k, i, j) for k, i, j in _matches(p, t, p_mark, t_mark, s)]
        heapify(queue)
        while queue:
            k, i, j = heappop(queue)
            free = [not p_mark[i + x] and not t_mark[j + x] for x in range(-k)]
            if all(free):
                p_mark[i : i - k] = t_mark[j : j - k] = [True] * -k
                out.append((-k, i, j))
                continue
            x = 0
            while x < -k:  # a longer tile has covered some of it: what is left takes its turn by its own length
                y = x
                while y < -k and free[y]:
                    y += 1
                if y - x >= s:
                    heappush(queue, (x - y, i + x, j + x))
                x = y + 1
        if s <= least:
            return out
        s = max(least, s // 2)


class Seeds:
    """The items of one part: their words as numbers, and their windows by hash."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item_id, ids, min(least, len(ids))))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sorted({least for _, _, least in self.items}):
            rows = [(h, k) for k, (_, ids, own) in enumerate(self.items) if own == m for h in self.hashes(np.array(ids, np.uint64), m).tolist()]
            pairs = sorted(set(rows))
            hashes, first = np.unique(np.array([h for h, _ in pairs], np.uint64), return_index=True)
            self.by_length[m] = (hashes, np.append(first, len(pairs)), np.array([k for _, k in pairs], np.int64))

    @staticmethod
    def hashes(ids: np.ndarray, m: int) -> np.ndarray:
        n = len(ids) - m + 1
        h = np.zeros(max(0, n), np.uint64)
        for i in range(m if n > 0 else 0):
            h = (h ^ ids[i : i + n]) * _MULT
            h ^= h >> np.uint64(29)
        return h

    def covered(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(index of the text, index of the item, words under tiles, longest tile) for pairs that share a seed."""
        get = self.vocabulary.get
        lists = [[get(w, 0) for w in words(t)] for t in texts]
        gap = [0] * max(self.by_length, default=1)
        flat = np.array([i for ids in lists for x in (ids, gap) for i in x], np.uint64)
        starts = np.cumsum([0] + [len(ids) + len(gap) for ids in lists])
        out = []
        for m, (hashes, first, owner) in self.by_length.items():
            if len(flat) < m or not len(hashes):
                continue
            zeros = np.concatenate(([0], np.cumsum(flat == 0)))
            at = np.flatnonzero(zeros[m:] == zeros[:-m])
            own = self.hashes(flat, m)[at]
            spot = np.searchsorted(hashes, own)
            hit = hashes[np.minimum(spot, len(hashes) - 1)] == own
            at, spot = at[hit], spot[hit]
            places: dict[tuple[int, int], list[int]] = defaultdict(list)
            texts_at = np.searchsorted(starts, at, side="right") - 1
            for a, d, k in zip(at.tolist(), texts_at.tolist(), spot.tolist()):
                for item in owner[first[k] : first[k + 1]].tolist():
                    places[d, item].append(a)
            for (d, item), where in places.items():
                stretch, end = [], -1
                for a in where:
                    if a > end:
                        stretch.append(0)
                    stretch.extend(flat[max(a, end) : a + m].tolist())
                    end = a + m
                found = tiles(self.items[item][1], [int(x) for x in stretch], m)
                if found:
                    out.append((d, item, sum(k for k, _, _ in found), max(k for k, _, _ in found)))
        return out


def seed_parts(benchmark: DataFrame, least: int = MIN_MATCH):
    """The items as broadcasts of Seeds, each of at most about PART_BYTES of text; at least one. The driver holds one part at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield spark.sparkContext.broadcast(Seeds(sorted(map(tuple, own.collect()), key=lambda x: (x[0] is None, x)), least))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH) -> DataFrame:
    """Pairs of a document and an item of which at least `threshold` of the words is under tiles of the document.

    (doc_id, item_id, n_item_words, n_covered, longest, coverage). An item of fewer than `least` words must occur whole. Null or
    empty texts, on either side, give no row. A repeated row of docs gives its rows again; equal rows of benchmark count once.
    """
    import pyarrow as pa

    schema = "doc_id long, item_id long, n_item_words int, n_covered int, longest int, coverage double"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = [x.split()[0] for x in schema.split(", ")]
    bounded_batches(docs.sparkSession)
    found = None
    for seeds in seed_parts(benchmark, least):

        def run(batches, seeds=seeds):
            known = seeds.value
            for b in batches:
                doc_ids = b.column(0).to_pylist()
                rows = []
                for d, k, n, longest in known.covered(b.column(1).to_pylist()):
                    item_id, ids, _ = known.items[k]
                    if n >= threshold * len(ids):
                        rows.append((doc_ids[d], item_id, len(ids), n, longest, n / len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

        one = texts_of(docs).mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    return found


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def cleaned(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH) -> DataFrame:
    """docs without the rows whose text holds `threshold` of an item, found as in contaminated() where the row lies: no row is moved.

    Each row is judged by its own text; null and empty texts stay; null and repeated doc_ids and extra columns make no difference.
    """
    import pandas as pd

    def holding(seeds):
        @F.pandas_udf("boolean")
        def holds(texts):
            known = seeds.value
            out = [False] * len(texts)
            for d, k, n, _ in known.covered(["" if t is None else t for t in texts]):
                out[d] = out[d] or n >= threshold * len(known.items[k][1])
            return pd.Series(out, dtype=bool)

        return holds

    bounded_batches(docs.sparkSession)
    for seeds in seed_parts(benchmark, least):
        docs = docs.where(~holding(seeds)(docs["text"].cast("string")))
    return docs
