"""Best-fit packing by a configuration linear program (operator 7).

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths, at most `capacity` numbers, goes to
the driver. The program "fewest sequences so that the chosen configurations hold every length as often as it occurs" is solved
by multiplicative weights: each length has a price that falls as it is covered, a knapsack dynamic program over capacity finds
the dearest configurations, and all near-dearest ones of a round are used. The fractional counts are rounded from the longest pieces
down: whole counts first, then one more of each that has a remainder, while there are pieces; what is left is a smaller program,
solved and rounded again. The last few pieces, with the few sequences that came out emptiest, go by best fit decreasing. All of it
works on (length, how often), at any size the same way.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ranked, table, texts_of, tokenizer_path
from .tokens import word_ids

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Rounds of pricing, and how much of the dearest configuration's value another must have to be used in its round.
ROUNDS, NEAR = 60, 0.95
#: How fast a price falls with the covered share, and by how much of the demand a round may go beyond the mean share.
RATE, STEP = 6.0, 0.1
#: Share of the tokens that one rounding places before the program is solved again for the rest.
SHARE = 0.3
#: Shares of the pieces that go by best fit decreasing: the last ones, and at most so many, in steps, of the
#: emptiest sequences with them.
TAIL, SPARE, SPARE_STEPS = 0.03, 0.06, 12
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole capacities, the first piece may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each piece. A null text is empty: its one token is the end id."""
    import pyarrow as pa

    path = path or tokenizer_path(TOKENIZER)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder = word_ids(path, True)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids += end
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, PIECES)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best total value at each capacity, and the index of the length that was added last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        sums = best[c - lengths[:k]] + values[:k]
        j = int(sums.argmax())
        best[c], last[c] = sums[j], j
    return best, last


Configuration = tuple[tuple[int, int], ...]


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Fractional solution {((index of length, how often), ...): how many sequences}, covering demand on average once."""
    cover = np.zeros(len(lengths))
    used: dict[Configuration, float] = {}
    for _ in range(rounds):
        share = cover / demand
        mean = float((cover * lengths).sum() / (demand * lengths).sum())
        values = lengths / capacity * np.exp(-RATE * (share - mean))
        best, last = price(values, lengths, capacity)
        full = best[capacity]
        behind = np.argsort(share, kind="stable")
        target = mean + STEP
        for j in behind:
            if cover[j] / demand[j] >= target or values[j] + best[capacity - lengths[j]] < NEAR * full:
                continue
            count = Counter([int(j)])
            room = capacity - int(lengths[j])
            while room > 0 and last[room] >= 0:
                count[int(last[room])] += 1
                room -= int(lengths[last[room]])
            if any(m > demand[k] for k, m in count.items()):  # more than there are: keep what there is
                count = Counter({k: min(m, int(demand[k])) for k, m in count.items()})
            key = tuple(sorted(count.items()))
            many = min((target * demand[k] - cover[k]) / m for k, m in key)
            if many <= 0:
                continue
            used[key] = used.get(key, 0) + many
            for k, m in key:
                cover[k] += m * many
    scale = float((cover * lengths).sum() / (demand * lengths).sum()) if used else 1
    return {k: v / max(scale, 1e-12) for k, v in used.items()}


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Counter:
    """Best fit decreasing: {configuration: how many}. Equal bins are one entry with a count, so the work follows the number of
    lengths: of a run of equal pieces each bin in turn, the tightest first, takes as many as it has room for."""
    rooms: list[int] = []  # sorted
    bins: dict[int, dict[Configuration, int]] = {}  # by room

    def put(room: int, key: Configuration, n: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = {}
        bins[room][key] = bins[room].get(key, 0) + n

    for j in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[j]), int(demand[j])
        fresh: list[tuple[int, Configuration, int]] = []
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, key, n = capacity, (), -(-left // (capacity // size))
            else:
                room = rooms[at]
                key, n = bins[room].popitem()
                if not bins[room]:
                    del bins[room], rooms[at]
            most = room // size
            whole = min(n, left // most)
            if whole:
                fresh.append((room - most * size, (*key, (j, most)), whole))
                left -= whole * most
            if left and whole < n:  # one bin takes the rest
                fresh.append((room - left * size, (*key, (j, left)), 1))
                left, whole = 0, whole + 1
            if key and whole < n:
                put(room, key, n - whole)
        for x in fresh:
            put(*x)
    out: Counter = Counter()
    for own in bins.values():
        for key, n in own.items():
            out[tuple(sorted(key))] += n
    return out


def rounded(lengths: np.ndarray, demand: np.ndarray, found: dict[Configuration, float], capacity: int, share: float = SHARE) -> tuple[Counter, np.ndarray]:
    """Whole counts of configurations, and what they leave of demand: from the longest piece down, until `share` of the tokens is
    placed, each length's configurations (those in which it is the longest) by their whole counts, then one more of those with a
    remainder, the fullest first, while there are pieces. Short pieces, which fit in anywhere, stay for later solutions."""
    whole: Counter = Counter()
    rest = demand.copy()
    fill = {key: sum(int(lengths[k]) * m for k, m in key) for key in found}
    of: dict[int, list[Configuration]] = {}
    for key in found:
        of.setdefault(key[-1][0], []).append(key)
    goal, done = share * float((lengths * demand).sum()), 0
    for j in range(len(lengths) - 1, -1, -1):
        if done >= goal:
            break
        own = sorted(of.get(j, ()), key=lambda key: (-fill[key], -found[key], key))
        for key, most in [(key, int(found[key])) for key in own] + [(key, 1) for key in own if found[key] > int(found[key])]:
            n = min(most, min(int(rest[k]) // m for k, m in key))
            if n > 0:
                whole[key] += n
                done += n * fill[key]
                for k, m in key:
                    rest[k] -= n * m
    return whole, rest


def _named(lengths: np.ndarray, whole: Counter) -> Counter:
    return Counter({tuple((int(lengths[k]), m) for k, m in key): n for key, n in whole.items()})


def _as_arrays(left: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(left), np.int64), np.array(list(left.values()), np.int64)


def _emptiest(chosen: Counter, pieces: int, capacity: int) -> Counter:
    """The sequences with the most room, as many as hold at most so many pieces."""
    out: Counter = Counter()
    for key, n in sorted(chosen.items(), key=lambda kn: (sum(a * m for a, m in kn[0]), kn[0])):
        size = sum(m for _, m in key)
        take = min(n, pieces // size)
        if take:
            out[key] = take
            pieces -= take * size
        if take < n or sum(a * m for a, m in key) == capacity:
            break
    return out


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Configuration, int]], int]:
    """[(((length, how often), ...), sequences)] that hold each length exactly as often as the histogram says, and how many pieces
    shorter than the capacity are where rounding put them."""
    chosen: Counter = Counter()
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    full = left.pop(capacity, 0)
    total = sum(left.values())
    while sum(left.values()) > TAIL * total:
        lengths, demand = _as_arrays(left)
        whole, rest = rounded(lengths, demand, configurations(lengths, demand, capacity), capacity)
        if not whole:
            break
        chosen.update(_named(lengths, whole))
        left = {int(a): int(b) for a, b in zip(lengths, rest) if b}
    by_rounding = total - sum(left.values())
    # the tail, with as many of the sequences that came out emptiest as saves most
    pieces = lambda some: sum(n * sum(m for _, m in key) for key, n in some.items())
    fewest, tail, out = None, Counter(), Counter()
    for step in range(SPARE_STEPS + 1):
        spare = _emptiest(chosen, int(SPARE * total * step / SPARE_STEPS), capacity)
        more = Counter(left)
        for key, n in spare.items():
            more.update({a: m * n for a, m in key})
        lengths, demand = _as_arrays(dict(sorted(more.items())))
        packed_again = _named(lengths, best_fit(lengths, demand, capacity))
        if fewest is None or packed_again.total() - spare.total() < fewest:
            fewest, tail, out = packed_again.total() - spare.total(), packed_again, spare
    chosen.subtract(out)
    by_rounding -= pieces(out)
    chosen.update(tail)
    if full:
        chosen[((capacity, 1),)] += full
    return sorted((key, n) for key, n in chosen.items() if n), by_rounding


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """The sequences of planned()."""
    return planned(histogram, capacity)[0]


def layout(chosen) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how often in a sequence, first sequence, offset of the first): where ranks of a length go."""
    rows, taken, sequence = [], Counter(), 0
    for key, n in chosen:
        offset = 0
        for length, m in key:
            rows.append((length, taken[length], taken[length] + m * n, m, sequence, offset))
            taken[length] += m * n
            offset += m * length
        sequence += n
    return rows


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece, its end token; a very long one is as many pieces as it takes. Repeated rows are packed as
    often as they occur; rows with a null doc_id too. Extra columns are ignored. An empty table gives an empty result. Ties are broken by doc_id, piece and checksum.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, capacity, path), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = layout(plan(histogram, capacity))
    places = spark.createDataFrame(rows, "length long, a long, b long, m long, sequence long, at long")
    places = places.groupBy("length").agg(F.collect_list(F.struct("a", "b", "m", "sequence", "at")).alias("places"))
    r = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], sum(histogram.values()))
    r = r.join(F.broadcast(places), "length")  # at most `capacity` rows; the plan has at most ROUNDS * capacity configurations a solution, and solutions grow with log(1 / TAIL)
    r = r.withColumn("p", F.filter("places", lambda p: (p.a <= F.col("rank")) & (F.col("rank") < p.b))[0])
    k = F.col("rank") - F.col("p.a")
    return r.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("p.sequence") + F.floor(k / F.col("p.m"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + (k % F.col("p.m")) * F.col("length")).cast("long").alias("offset"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
