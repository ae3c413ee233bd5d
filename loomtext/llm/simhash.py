"""SimHash near-duplicates by a self-join of binary tries (operator 10).

Fingerprints of 64 bits come from XXH64 hashes of word shingles. Two link when they differ in at most `budget` bits. The bits
are cut into `blocks` runs; any two linked fingerprints agree on at least blocks - budget whole runs, so each choice of that
many runs deals the fingerprints out by the bits of those runs, and each group is a binary trie joined with itself: pairs of
nodes are walked together from the root, a pair adds a differing bit where its branches part, and goes as soon as that sum
exceeds the budget. Subtrees whose leaves are all in one component already are not walked again, so a group of many close
copies gives links that grow with its size, not with its square.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, free_name, materialize, table, texts_of
from .components import components

BITS = 64
SEED = 42
#: Rows that one call of the trie join takes, unless one group alone is larger.
CHUNK_ROWS = 200_000


def fingerprint_array(texts: list[str], words_per_shingle: int = 4, distinct: bool = False) -> np.ndarray:
    """uint64 fingerprints: lower-cased A-Z, words between ASCII white space, shingles with repeats (distinct: each once); no word
    gives zero."""
    import xxhash

    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    parts, owners, counts, held = [], [], [], 0

    def flush() -> None:
        if not owners:
            return
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = (2 * ones > np.asarray(counts)[:, None]).astype(np.uint8)
        out[owners] = np.packbits(major, axis=1).reshape(-1).view(">u8").astype(np.uint64)
        parts.clear(), owners.clear(), counts.clear()

    k = words_per_shingle
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        shingles = map(b" ".join, zip(*(words[j:] for j in range(k)))) if len(words) >= k else [b" ".join(words)]
        if distinct:
            shingles = sorted(set(shingles))
        hashes = list(map(digest, shingles, repeat(SEED)))
        parts += hashes
        n = len(hashes)
        owners.append(i), counts.append(n)
        held += n
        if held >= 100_000:
            flush()
            held = 0
    flush()
    return out


def with_fingerprints(rows: DataFrame, words_per_shingle: int = 4, distinct: bool = False) -> DataFrame:
    """rows, whose last column is their text, with fp in its place; a null or empty text has fingerprint zero."""
    import pyarrow as pa

    keys = rows.columns[:-1]

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            fp = fingerprint_array(texts, words_per_shingle, distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*keys, "fp"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "fp long"]))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, distinct: bool = False) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""
    return with_fingerprints(texts_of(docs), words_per_shingle, distinct)


def runs_of(blocks: int) -> list[int]:
    """Masks of `blocks` runs of bits that cover all 64."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]


def blocks_for(n: int, budget: int) -> int:
    """The fewest runs with about 32 fingerprints or fewer in a group, were they random. Links are the same for any value."""
    for blocks in range(budget + 1, 2 * budget + 4):
        if n / 2 ** (BITS * (blocks - budget) / blocks) <= 32:
            return blocks
    return 2 * budget + 4


def _settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after linking a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def trie_links(keys: np.ndarray, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join the values of equal key at `budget` differing bits or fewer into their components.

    Walks the tries of all keys at once, level by level. The budget grows from 1 so that dense groups are joined by their
    nearest links first; then a pair of nodes whose leaves are all in one component is left out.
    """
    order = np.lexsort((values, keys))
    key, val = keys[order], values[order]
    n = len(val)
    label = np.arange(n)
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    roots = np.stack((bounds[:-1], bounds[1:]), 1)
    roots = roots[roots[:, 1] - roots[:, 0] > 1]
    spread = int(np.bitwise_or.reduce(val)) & ~int(np.bitwise_and.reduce(val)) if n else 0
    for most in range(0, budget + 1):
        run = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if n else np.zeros(0, int)
        one = lambda lo, hi: run[hi - 1] == run[lo]  # noqa: E731  all leaves in one component
        own = roots
        alo = ahi = blo = bhi = diff = np.zeros(0, np.int64)
        left, right = [], []
        for bit in range(BITS - 1, -2, -1):
            if bit >= 0 and not spread >> bit & 1:
                continue
            single = (ahi - alo == 1) & (bhi - blo == 1)
            if single.any():
                x, y = alo[single], blo[single]
                near = np.bitwise_count(val[x] ^ val[y]) <= most
                left.append(x[near]), right.append(y[near])
                alo, ahi, blo, bhi, diff = (z[~single] for z in (alo, ahi, blo, bhi, diff))
            if bit < 0:
                break
            ones = np.concatenate(([0], np.cumsum((val >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
            lo, hi = own[:, 0], own[:, 1]
            mid = hi - (ones[hi] - ones[lo])
            fresh = (lo < mid) & (mid < hi)
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            alo, ahi, blo, bhi, diff = (
                np.concatenate(z)
                for z in (
                    (alo, amid, alo, amid, lo[fresh]),
                    (amid, ahi, amid, ahi, mid[fresh]),
                    (blo, bmid, bmid, blo, mid[fresh]),
                    (bmid, bhi, bhi, bmid, hi[fresh]),
                    (diff, diff, diff + 1, diff + 1, np.ones(int(fresh.sum()), np.int64)),
                )
            )
            keep = (alo < ahi) & (blo < bhi) & (diff <= most)
            alo, ahi, blo, bhi, diff = (z[keep] for z in (alo, ahi, blo, bhi, diff))
            joined = one(alo, ahi) & one(blo, bhi) & (label[alo] == label[blo])
            if joined.any():
                alo, ahi, blo, bhi, diff = (z[~joined] for z in (alo, ahi, blo, bhi, diff))
            own = np.concatenate((np.stack((lo, mid), 1), np.stack((mid, hi), 1)))
            own = own[own[:, 1] - own[:, 0] > 1]
            if len(own):
                own = own[~one(own[:, 0], own[:, 1])]
        # leaves of equal value stay together in `own` to the end
        if most == 0 and len(own):
            for lo, hi in own:
                left.append(np.arange(lo + 1, hi)), right.append(np.full(hi - lo - 1, lo))
        if left:
            label = _settle(n, np.concatenate(left), np.concatenate(right), label)
    far = np.flatnonzero(label != np.arange(n))
    return order[far], order[label[far]]


def links(fps: DataFrame, budget: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints of fps (column fp) that span the components at `budget` bits."""
    import pyarrow as pa

    distinct = fps.select("fp").distinct()
    blocks = blocks or blocks_for(distinct.count(), budget)
    masks = [sum(c) for c in combinations(runs_of(blocks), blocks - budget)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    dealt = distinct.select("fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("band", "bits"))
    dealt = dealt.select("band", "bits", "fp").repartition("band", "bits").sortWithinPartitions("band", "bits")

    def run(batches):
        held, rows = [], 0

        def join(chunk):
            band, bits, fp = (np.concatenate(z) for z in zip(*chunk))
            keys = np.cumsum(np.concatenate(([0], (band[1:] != band[:-1]) | (bits[1:] != bits[:-1]))))
            a, b = trie_links(keys, fp.view(np.uint64), budget)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append(cols)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                cols = [np.concatenate(z) for z in zip(*held)]
                new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                if len(new):
                    cut = new[-1] + 1  # the last key may go on in the next batch
                    yield join([[c[:cut] for c in cols]])
                    held = [[c[cut:] for c in cols]]
                    rows = len(held[0][0])
        if rows:
            yield join(held)

    bounded_batches(fps.sparkSession)
    return dealt.mapInArrow(run, "u long, v long")


def named(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, component_id): for each fingerprint of fps (doc_id, fp) the smallest doc_id that links reach."""
    edges = materialize(links(fps, budget), "links")
    root = components(edges)
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = classes.join(root.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "classes")
    discard(edges), discard(root)
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return classes.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint hex, component_id).

    component_id is the smallest doc_id that links reach. A null or empty text has fingerprint zero, which links like any
    other. Repeated rows and equal texts share a component. Rows with a null doc_id keep it and never name a component unless
    all rows of it have none. Very long texts are read whole. Extra columns of docs are ignored; an empty table gives an empty
    result.
    """
    fps = materialize(fingerprints(docs, words_per_shingle), "fp")
    return fps.join(named(fps, budget), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingle_set(text: str, words_per_shingle: int = 5) -> frozenset[bytes]:
    words = text.encode().lower().split()
    if len(words) < words_per_shingle:
        return frozenset([b" ".join(words)])
    return frozenset(map(b" ".join, zip(*(words[j:] for j in range(words_per_shingle)))))


#: Buckets of shingle counts (the only table that goes to the driver), the bits of a hash below its bucket, and the slices in which
#: counts travel.
BUCKET_BITS, SLICES = 20, 1024
BELOW = np.uint64(64 - BUCKET_BITS)
#: Postings that a task gathers before it deals them out, and postings of a bucket, about.
BLOCK_POSTINGS, BUCKET_POSTINGS = 1 << 18, 1 << 18
#: Bits of a shingle's hash that are left out when postings meet; texts are compared word for word afterwards.
LEFT_OUT = np.uint64(16)
#: How often documents that are the first of all their runs are taken first, at most; the result is the same for any number.
ROUNDS = 8
#: Pairs a lead is compared with in one task, about.
PAIRS_A_TASK = 1000
#: Buckets of document ids; those of candidates are broadcast.
TEXT_BUCKETS = 1 << 20
#: Texts in a run of equal postings from which on it is not paired at once.
SMALL_RUN = 16
MEETINGS = "h long, t long, size int, pos int, b long"


def shingle_hashes(text: str) -> np.ndarray:
    """A uint64 hash of each distinct five-word shingle."""
    import xxhash

    own = shingle_set(text)
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in own), np.uint64, len(own))


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of numbers by place, so that equal high bytes stand together and compress."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of texts (t, text), each once a row, fall into each bucket of hashes."""
    import pyarrow as pa

    width = (1 << BUCKET_BITS) // SLICES
    names = ["slice", "data"]

    def count(batches):
        total, held, n = np.zeros(1 << BUCKET_BITS, np.int64), [], 0

        def add():
            nonlocal total
            if held:
                total += np.bincount((np.concatenate(held) >> BELOW).astype(np.int64), minlength=len(total))

        for b in batches:
            for text in b.column(1).to_pylist():
                held.append(shingle_hashes(text))
                n += len(held[-1])
                if n >= BLOCK_POSTINGS:
                    add()
                    held, n = [], 0
        add()
        own = [(i, planes(x)) for i, x in enumerate(total.reshape(SLICES, width)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=names)

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + unplanes(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([planes(x) for x in sums.values()], pa.binary())], names=names)

    bounded_batches(texts.sparkSession)
    schema = "slice int, data binary"
    out = np.zeros((SLICES, width), np.int64)
    for r in texts.mapInArrow(count, schema).repartition("slice").mapInArrow(add_up, schema).collect():  # 2^20 numbers
        out[r.slice] = unplanes(r.data, np.int64)
    return out.reshape(-1)


def postings(texts: DataFrame, often: np.ndarray, similarity: float, buckets: int) -> DataFrame:
    """(bucket, data): the first shingles of each text of texts (t, text), in one order of all shingles, rare ones first, dealt out by
    hash; data has hash, t, number of shingles and place for each, sorted by hash.

    Two texts of at least that similarity share one of the size - ceil(similarity * size) + 1 shingles that each gives, in
    whatever order, so none is missed. The order is by the count of the shingle's bucket, then by hash. Equal texts, which have
    equal t, give theirs once a block.
    """
    import pyarrow as pa

    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(np.minimum(often, (1 << 32) - 1).astype(np.uint32))
    bounded_batches(spark)

    def run(batches):
        rank = counts.value
        held, seen, n = [], set(), 0

        def emit():
            h = np.concatenate([x for x, _, _ in held])
            length = np.array([len(x) for x, _, _ in held])
            t = np.repeat(np.array([x for _, x, _ in held], np.int64), length)
            size = np.repeat(np.array([x for _, _, x in held], np.uint32), length)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, t, size, pos = h[order], t[order], size[order], pos[order]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            h >>= LEFT_OUT
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            keys, data, held_bytes = [], [], 0
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                keys.append(int(bucket[a]))
                data.append(b"".join((planes(np.diff(h[a:b], prepend=np.uint64(0))), planes(t[a:b]), planes(size[a:b]), planes(pos[a:b]))))
                held_bytes += len(data[-1])
                if held_bytes > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])
                    keys, data, held_bytes = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t in seen:
                    continue
                seen.add(t)
                h = shingle_hashes(text)
                first = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
                held.append((h[np.lexsort((h, rank[(h >> BELOW).astype(np.int64)]))[:first]], t, len(h)))
                n += len(held[-1][0])
                if n >= BLOCK_POSTINGS:
                    yield from emit()
                    held, seen, n = [], set(), 0
        if held:
            yield from emit()

    return texts.mapInArrow(run, "bucket long, data binary")


class Bucket:
    """The postings of one bucket as they come, by runs of equal hash.

    A run of more than SMALL_RUN texts is hot: its postings are given as they are, and two are kept to know it by. Of the other
    runs close() gives the pairs that may be similar; they are held together, about BUCKET_POSTINGS in all.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.h, self.t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.pos, self.hot = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, blocks: list[bytes]) -> tuple[np.ndarray, ...]:
        own = [[self.h, self.t, self.size, self.pos]]
        for data in blocks:
            n = len(data) // 24
            own.append([np.cumsum(unplanes(data[: 8 * n], np.uint64), dtype=np.uint64), unplanes(data[8 * n : 16 * n], np.int64), *(unplanes(x, np.uint32).astype(np.int64) for x in (data[16 * n : 20 * n], data[20 * n :]))])
        h, t, size, pos = (np.concatenate(x) for x in zip(*own))
        known = np.concatenate((self.hot, np.zeros(len(h) - len(self.h), bool)))
        order = np.lexsort((np.arange(len(h)), t, h))
        h, t, size, pos, known = (x[order] for x in (h, t, size, pos, known))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
        h, t, size, pos, known = (x[new] for x in (h, t, size, pos, known))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.diff(np.append(first, len(h)))
        hot = np.repeat((many > SMALL_RUN) | np.logical_or.reduceat(known, first), many)
        out = hot & ~known
        found = h[out].view(np.int64), t[out], size[out].astype(np.int32), pos[out].astype(np.int32)
        keep = ~hot | (np.arange(len(h)) - np.repeat(first, many) < 2)
        self.h, self.t, self.size, self.pos, self.hot = h[keep], t[keep], size[keep], pos[keep], hot[keep]
        return found

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        h, t, size, pos = (x[~self.hot] for x in (self.h, self.t, self.size, self.pos))
        a, b = [], []
        for apart in range(1, SMALL_RUN):
            i = np.flatnonzero(h[apart:] == h[:-apart])
            if not len(i):
                break
            j = i + apart
            near = may_be_similar(size[i], pos[i], size[j], pos[j], self.similarity)
            a.append(t[i[near]]), b.append(t[j[near]])
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1))


def may_be_similar(size, pos, other_size, other_pos, similarity: float):
    """Whether two texts with a common posting can be similar, if it is their first: by their sizes, and by what comes after it."""
    both = np.ceil(similarity / (1 + similarity) * (size + other_size) - 1e-9)
    fit = np.minimum(size, other_size) >= similarity * np.maximum(size, other_size) - 1e-9
    return fit & (np.minimum(size - pos, other_size - other_pos) >= both)


def meetings(dealt: DataFrame, similarity: float) -> DataFrame:
    """(h, t, size, pos, b): the postings of hot runs, b null; and with h null pairs of texts (t, b) that meet in other runs and may
    be similar. Some come more than once."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in MEETINGS.split(", ")]
    batch = lambda h, t, size, pos, b, n: pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in zip((h, t, size, pos, b), kinds)], names=names)

    def run(batches):
        key, own, held, n = None, Bucket(similarity), [], 0

        def give(last: bool):
            found = own.add(held)
            if len(found[0]):
                yield batch(*found, None, len(found[0]))
            if last:
                a, b = own.close()
                if len(a):
                    yield batch(None, a, None, None, b, len(a))

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (k != key or n >= CHUNK_ROWS):
                    yield from give(k != key)
                    held, n = [], 0
                if k != key:
                    key, own = k, Bucket(similarity)
                held.append(data)
                n += len(data) // 24
        if held:
            yield from give(True)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MEETINGS)


def in_runs(rows: DataFrame, f, schema: str) -> DataFrame:
    """f over the columns of rows, sorted by h, size and o, for many whole runs of equal h at a time; f gives columns of schema."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held, n = [], 0

        def done(cols):
            for out in f(*cols):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                cols = [np.concatenate(z) for z in zip(*held)]
                new = np.flatnonzero(cols[0][1:] != cols[0][:-1])
                held, n = [cols], len(cols[0])
                if len(new):
                    cut = new[-1] + 1  # the last run may go on in the next batch
                    yield from done([c[:cut] for c in cols])
                    held, n = [[c[cut:] for c in cols]], n - cut
        if n:
            yield from done([np.concatenate(z) for z in zip(*held)])

    bounded_batches(rows.sparkSession)
    return rows.repartition("h").sortWithinPartitions("h", "size", "o").mapInArrow(run, schema)


def windows(h: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each posting the range of those of its run whose sizes allow the similarity."""
    run = np.cumsum(np.concatenate(([0], h[1:] != h[:-1]))).astype(np.int64) << 32
    key = run + size
    low, high = np.ceil(similarity * size - 1e-9).astype(np.int64), np.floor(size / similarity + 1e-9).astype(np.int64)
    return np.searchsorted(key, run + low), np.searchsorted(key, run + high, "right")


def candidates(rows: DataFrame, similarity: float, part: int = 1_000_000) -> DataFrame:
    """(u, v), u < v: documents of postings (h, o, size, pos) that may be similar, none that is left out; made about `part` at a time.

    A pair goes by its first shared shingle if what comes after it in both is too little for the similarity.
    """

    def pairs(h, o, size, pos):
        lo, hi = windows(h, size, similarity)
        own = np.flatnonzero(hi - lo > 1)
        sums = np.cumsum(hi[own] - lo[own])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + part, "right")))
            x = own[at:to]
            n = hi[x] - lo[x]
            i = np.repeat(x, n)
            j = np.arange(len(i)) + np.repeat(lo[x] - (np.cumsum(n) - n), n)
            i, j = (z[o[i] < o[j]] for z in (i, j))
            near = may_be_similar(size[i].astype(np.int64), pos[i], size[j].astype(np.int64), pos[j], similarity)
            if near.any():
                yield np.unique(np.stack((o[i[near]], o[j[near]])), axis=1)
            at = to

    return in_runs(rows, pairs, "u long, v long").distinct()


def _with_firsts(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(u, v): v meets u as the first document of a run, and may be similar to it; (o): documents that some run shows with a smaller
    one. Sums over runs and a join: no run is gathered."""
    least = rows.groupBy("h").agg(F.min(F.struct("o", "size", "pos")).alias("u"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(least, "h").where(F.col("u.o") < F.col("o"))
    both = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("u.size")) - 1e-9)
    near = F.least(F.col("size") - F.col("pos"), F.col("u.size") - F.col("u.pos")) >= both
    return met.where(near).select(F.col("u.o").alias("u"), F.col("o").alias("v")), met.select("o")


def _similar(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts, of own (o, text), share their shingles to that similarity, compared exactly.

    The text of v goes to u, and that of u once to each task that compares it; a u of many pairs is salted.
    """
    import pyarrow as pa

    def run(batches):
        lead, mine = None, frozenset()
        for b in batches:
            found = []
            for u, salt, v, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if v is None:
                    lead, mine = (u, salt), shingle_set(text)
                elif (u, salt) == lead:
                    x = shingle_set(text)
                    n = len(x & mine)
                    if n >= similarity * (len(x) + len(mine) - n):
                        found.append((u, v))
            u, v = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    bounded_batches(own.sparkSession)
    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("salts"))
    dealt = pairs.join(salts, "u").select("u", F.pmod(F.xxhash64("v"), "salts").cast("int").alias("salt"), "v")
    leads = salts.select("u", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), F.lit(None).cast("long").alias("v"))
    rows = leads.join(own.withColumnRenamed("o", "u"), "u").select("u", "salt", "v", "text")
    rows = rows.union(dealt.join(own.withColumnRenamed("o", "v"), "v").select("u", "salt", "v", "text"))
    return rows.repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first()).mapInArrow(run, "u long, v long")


def _without(links: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """links whose column is not among ids (o)."""
    return links.join(ids.select(F.col("o").alias(column)), column, "left_anti").select("u", "v")


def _dropped(links: DataFrame) -> DataFrame:
    """(o): gone through upwards, a document goes if links (u, v), u < v, join it to a smaller one that stays.

    What is linked to documents without a smaller link goes first, a few times over; of what long chains leave, a task holds the
    ids that go of one component.
    """
    gone = []
    for _ in range(ROUNDS):
        led = links.select(F.col("v").alias("o")).distinct()
        out = materialize(_without(links, "u", led).select(F.col("v").alias("o")).distinct(), "copies")
        gone.append(out)
        links = materialize(_without(_without(links, "u", out), "v", out), "links")
        if links.isEmpty():
            return reduce(DataFrame.union, gone)
    return reduce(DataFrame.union, [*gone, _dropped_by_component(links)])


def _dropped_by_component(links: DataFrame) -> DataFrame:
    import pyarrow as pa

    root = components(links).select(F.col("u").alias("v"), F.col("v").alias("root"))

    def run(batches):
        key, gone = None, set()
        for b in batches:
            out = []
            for k, v, u in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key:
                    key, gone = k, set()
                if u not in gone and v not in gone:
                    gone.add(v)
                    out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["o"])

    bounded_batches(links.sparkSession)
    rows = links.join(root, "v").select("root", "v", "u").repartition("root").sortWithinPartitions("root", "v", "u")
    return rows.mapInArrow(run, "o long")


def text_hash(docs: DataFrame) -> Column:
    """A long that equal texts share (a null text is empty)."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _texts_of_pairs(docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(o, text) of the documents in pairs, from docs by the doc_id and text hash that firsts (t, o, own) has of them. A broadcast of
    at most TEXT_BUCKETS numbers lets most other texts stay where they are."""
    bucket = lambda own, t: F.pmod(F.xxhash64(own, t), F.lit(TEXT_BUCKETS)).cast("int")
    wanted = pairs.select(F.col("u").alias("o")).union(pairs.select("v")).distinct().join(firsts, "o")
    wanted = materialize(wanted.select("o", F.col("own").alias("its"), F.col("t").alias("hash")), "wanted")
    every = docs.select(docs["doc_id"].cast("long").alias("own"), text_hash(docs).alias("t"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    asked = wanted.select(bucket(F.col("its"), F.col("hash")).alias("bucket")).distinct()
    some = every.withColumn("bucket", bucket(F.col("own"), F.col("t"))).join(F.broadcast(asked), "bucket", "left_semi")
    some = some.join(wanted, F.expr("own <=> its and t = hash")).select("o", "text")
    out = materialize(some.dropDuplicates(["o"]), "candidate-texts")
    discard(wanted)
    return out


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""
    pairs = materialize(pairs.distinct(), "candidates")
    texts = _texts_of_pairs(docs, firsts, pairs)
    out = materialize(_similar(pairs, texts, similarity), "links")
    discard(pairs), discard(texts)
    return out


def _copies(docs: DataFrame, members: DataFrame, similarity: float, part: int) -> DataFrame:
    """(_id): those o of members (o, own, t) that go, own and t being the doc_id and text_hash() of their rows in docs."""
    texts = texts_of(docs)
    texts = texts.select(text_hash(texts).alias("t"), "text")
    often = shingle_counts(texts)
    buckets = max(1, int((1 - similarity) * often.sum()) // BUCKET_POSTINGS)
    firsts = materialize(members.groupBy("t").agg(F.min(F.struct("o", "own")).alias("f")).select("t", "f.o", "f.own"), "firsts")
    gone = [materialize(members.join(firsts.select("o"), "o", "left_anti").select("o"), "copies")]  # equal texts
    met = materialize(meetings(postings(texts, often, similarity, buckets), similarity), "meetings")
    rows = materialize(met.where("b is null").join(firsts.select("t", "o"), "t").select("h", "o", "size", "pos").distinct(), "postings")
    both = met.where("b is not null").select("t", "b").distinct().join(firsts.select("t", F.col("o").alias("x")), "t")
    both = both.join(firsts.select(F.col("t").alias("b"), F.col("o").alias("y")), "b")
    pairs = materialize(both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), "pairs")
    discard(met)
    for _ in range(ROUNDS):
        starred, led = _with_firsts(rows, similarity)
        led = materialize(led.union(pairs.select("v")).distinct(), "led")
        links = _verified(docs, firsts, _without(starred.union(pairs), "u", led), similarity)
        out = materialize(links.select(F.col("v").alias("o")).distinct(), "copies")
        rest = materialize(rows.join(led, "o", "left_semi").join(out, "o", "left_anti").select(*rows.columns), "postings")
        left = pairs.join(led.select(F.col("o").alias("u")), "u", "left_semi")
        left = materialize(_without(_without(left, "u", out), "v", out), "pairs")
        for x in (rows, led, pairs, links):
            discard(x)
        rows, pairs = rest, left
        gone.append(out)
        runs = rows.groupBy("h").count().agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("pairs")).first()
        if (runs.pairs or 0) <= SMALL_RUN * (runs.n or 0):
            break
    links = _verified(docs, firsts, candidates(rows, similarity, part).union(pairs), similarity)
    gone.append(materialize(_dropped(links), "copies"))
    out = materialize(reduce(DataFrame.union, gone).select(F.col("o").alias("_id")), "gone")
    for x in (firsts, rows, pairs, links, *gone):
        discard(x)
    return out


def near_copies(docs: DataFrame, similarity: float = 0.8, part: int = 1_000_000) -> DataFrame:
    """(_id): documents whose five-word shingles are similar to those of a document that stays, of docs with distinct doc_ids.

    One rule for any number of documents: in the order of doc_id, a document goes if it is similar to a smaller one that stays.
    Candidates are all pairs that share one of their rarest shingles (postings), which every similar pair does; shingles are then
    compared exactly. Documents that are the first of all runs of equal shingles they are in stay, and what is similar to them
    goes, a few times over, so that a group of many copies is compared with its first ones only; the links of what is left decide
    the rest by the same rule. `part` is how many candidates are made at a time; the result does not depend on it. Rows with a
    null doc_id are left out.
    """
    own = texts_of(docs).where("doc_id is not null")
    members = own.select(F.col("doc_id").alias("o"), F.col("doc_id").alias("own"), text_hash(own).alias("t"))
    return _copies(own, members, similarity, part)


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without its near copies. Each text of a doc_id, null or repeated ids too, is a document of its own, in the order of doc_id,
    nulls last. Of equal rows one stays; of each component of near_duplicates() the first document; of what is left, documents go
    that share 0.8 or more of their five-word shingles with one that stays (near_copies). A null or empty text is a text without
    words; very long texts are read whole; extra columns stay; an empty table gives an empty one.

    Texts are read where they lie; only those of candidates, and in the end all that stay, are shuffled.
    """
    texts = texts_of(docs)
    rows = texts.select("doc_id", text_hash(texts).alias("t"), "text")
    keys = materialize(with_fingerprints(rows, 4).groupBy("doc_id", "t").agg(F.min("fp").alias("fp")), "keys")
    order = keys.sort(F.col("doc_id").asc_nulls_last(), "t").select(F.monotonically_increasing_id().alias("o"), F.col("doc_id").alias("own"), "t", "fp")
    order = materialize(order, "order")
    first = named(order.select(F.col("o").alias("doc_id"), "fp")).select(F.col("component_id").alias("o")).distinct()
    members = materialize(order.join(first, "o", "left_semi").select("o", "own", "t"), "members")
    gone = _copies(docs, members, similarity, 1_000_000)
    stay = materialize(members.join(gone.withColumnRenamed("_id", "o"), "o", "left_anti").select("own", "t"), "stay")
    for x in (keys, order, members, gone):
        discard(x)
    none, own, t = (free_name(docs, x) for x in ("none", "own", "t"))
    key = lambda own_id, text: {none: own_id.isNull(), own: F.coalesce(own_id, F.lit(0)), t: text}
    left = docs.withColumns(key(docs["doc_id"].cast("long"), text_hash(docs)))
    right = stay.select(*(c.alias(k) for k, c in key(F.col("own"), F.col("t")).items()))
    return left.join(right, [none, own, t], "left_semi").dropDuplicates([none, own, t]).select(*docs.columns)
