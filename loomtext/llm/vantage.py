"""Nearest neighbours by inner product, from vantage-point trees in shards (operator 11).

Equal vectors are one entry with their smallest ids, at most as many as an answer can hold, so a vector that many rows share costs no more
than another. Entries are dealt to the nearest of some pivots, a bounded sample, and a pivot with many entries is dealt further by hash: each
shard holds a bounded number and gets a vantage-point tree. Queries go, in blocks, to the shards that may hold something for them.

A branch whose points are between `low` and `high` away from a vantage point, and at most `norm` long, holds no inner product over
(|q|^2 + norm^2 - gap^2) / 2, where gap is how far the query is outside of that shell (triangle inequality). Branches, and shards in
the same way, are left out if that is under the worst score that still counts. `factor` makes the gap that many times larger: over one, fewer branches
are visited and some neighbours are missed; one is exact. The score that counts starts at what the sample alone would give.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, part_rows, table

K, EVERY, FACTOR = 20, 20, 1.0
#: Entries of a shard, queries of a block, points of a leaf.
SHARD, BLOCK, LEAF = 16_000, 16_000, 256
#: Entries on the driver: the sample that pivots and first bounds come from, and the most pivots.
SAMPLE, PIVOTS = 2048, 1024
#: Share of the lengths' product by which a rounded inner product may be off.
SLACK = 1e-11
#: Candidates of a block that are held before those that no longer count go.
HELD = 2_000_000


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, added from the first component to the last."""
    out = a[:, 0] * b[:, 0]
    for d in range(1, a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def bound(q2: np.ndarray, norm: float, gap: np.ndarray, factor: float) -> np.ndarray:
    """The largest inner product of a query, of squared length q2, with points at most norm long and at least gap * factor away."""
    return np.minimum((q2 + norm * norm - (gap * factor) ** 2) / 2, np.sqrt(q2) * norm)


class Tree:
    """A vantage-point tree over the rows of x."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norms = np.sqrt((x * x).sum(1))
        self.rng = np.random.default_rng(7)
        self.root = self._grown(np.arange(len(x)))

    def _away(self, at: np.ndarray, point: int) -> np.ndarray:
        diff = self.x[at] - self.x[point]
        return np.sqrt((diff * diff).sum(1))

    def _grown(self, at: np.ndarray):
        """(indices,) of a leaf; else (vantage point, limit, inner branch, outer branch) with (low, high, norm, node) for a branch."""
        if len(at) <= LEAF:
            return (at,)
        some = at[:: max(1, len(at) // 64)]
        point = max(self.rng.choice(at, 4), key=lambda p: self._away(some, p).std())
        away = self._away(at, point)
        limit = float(np.median(away))
        inside = away <= limit
        if inside.all():  # few distances: the rest is a leaf as it is
            inside = away < limit
            if not inside.any():
                return (at,)
        branch = lambda m: (float(away[m].min()), float(away[m].max()), float(self.norms[at[m]].max()), self._grown(at[m]))
        return point, limit, branch(inside), branch(~inside)

    def search(self, q: np.ndarray, start: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of x, score) of all that may be among a query's k best with scores of at least `start`; ties of the last are all there."""
        q2 = (q * q).sum(1)
        best = np.full((len(q), k), -np.inf)
        least = start.copy()  # what counts for each query
        slack = SLACK * np.sqrt(q2) * max(float(self.norms.max()), 1e-300)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def counted() -> None:
            nonlocal found, held
            a, b, s = (np.concatenate(c) for c in zip(*found))
            ok = s >= least[a]
            found, held = [(a[ok], b[ok], s[ok])], int(ok.sum())

        def leaf(at: np.ndarray, who: np.ndarray) -> None:
            nonlocal held
            rough = q[who] @ self.x[at].T
            a, b = np.nonzero(rough >= (least[who] - slack[who])[:, None])
            if not len(a):
                return
            score = inner(q[who[a]], self.x[at[b]])
            ok = score >= least[who[a]]
            a, b, score = a[ok], b[ok], score[ok]
            found.append((who[a], at[b], score))
            held += len(a)
            rough.fill(-np.inf)
            rough[a, b] = score
            some = np.unique(a)
            best[who[some]] = np.partition(np.concatenate([best[who[some]], rough[some]], axis=1), -k, axis=1)[:, -k:]
            least[who[some]] = np.maximum(least[who[some]], best[who[some]].min(1))
            if held > HELD:
                counted()

        def visit(branch, who: np.ndarray, gap: np.ndarray, away: np.ndarray | None) -> None:
            low, high, norm, node = branch
            if away is not None:
                gap = np.maximum(gap, np.maximum(away - high, low - away))
            ok = bound(q2[who], norm, gap, factor) >= least[who] - slack[who]
            who, gap = who[ok], gap[ok]
            if not len(who):
                return
            if len(node) == 1:
                leaf(node[0], who)
                return
            point, limit, inside, outside = node
            diff = q[who] - self.x[point]
            away = np.sqrt((diff * diff).sum(1))
            near = away <= limit
            for side, m in ((inside, near), (outside, ~near), (outside, near), (inside, ~near)):
                if m.any():
                    visit(side, who[m], gap[m], away[m])

        if len(q) and len(self.x):
            visit((0.0, np.inf, float(self.norms.max()), self.root), np.arange(len(q)), np.zeros(len(q)), None)
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        counted()
        return found[0]


def _matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows that take part, in double precision; shorter vectors go on with zeros."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()


def _most_of_an_id(vectors: DataFrame, rows: DataFrame) -> int:
    """How many distinct rows have one id at most: so many of a query's best may be its own."""
    most = lambda df: df.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return 1 if most(vectors.select("vec_id").where("vec_id is not null")) == 1 else most(rows)


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k smallest ids: no answer holds more of them."""
    same = Window.partitionBy("v").orderBy("vec_id")
    return rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _cells(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """entries with the nearest pivot, `cell`, and how far it is."""
    import pyarrow as pa

    dim, p2 = pivots.shape[1], (pivots * pivots).sum(1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(0), dim)
            cell = np.argmin(p2 - 2 * (x @ pivots.T), axis=1) if len(x) else np.zeros(0, np.int64)
            diff = x - pivots[cell]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int64)), pa.array(np.sqrt((diff * diff).sum(1))), pa.array(np.sqrt((x * x).sum(1)))], names=["v", "ids", "cell", "away", "norm"])

    return entries.mapInArrow(run, "v array<double>, ids array<long>, cell long, away double, norm double")


def _routed(queries: DataFrame, sample: np.ndarray, pivots: np.ndarray, cells: list, k: int, factor: float, blocks: int) -> DataFrame:
    """(shard, block, qid, least, v): queries with the k-th best score in the sample alone, for each shard that may hold more."""
    import pyarrow as pa

    dim = pivots.shape[1]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                q, ids = _matrix(part.column(0), dim), part.column(1).to_numpy()
                q2 = (q * q).sum(1)
                least = np.full(len(q), -np.inf)
                if len(sample) >= k:
                    least = np.partition(q @ sample.T, -k, axis=1)[:, -k] - SLACK * np.sqrt(q2 * (sample * sample).sum(1).max())
                who, shard = [], []
                for cell, parts, radius, norm in cells:
                    diff = q - pivots[cell]
                    gap = np.maximum(np.sqrt((diff * diff).sum(1)) * (1 - SLACK) - radius, 0)
                    ok = np.flatnonzero(bound(q2, norm, gap, factor) >= least - SLACK * np.sqrt(q2) * norm)
                    who.append(np.tile(ok, parts))
                    shard.append(np.repeat((cell << 32) + np.arange(parts), len(ok)))
                who, shard = np.concatenate(who), np.concatenate(shard)
                for j in range(0, len(who), 4096):
                    w = who[j : j + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[j : j + 4096]), part.column(2).take(pa.array(w)), pa.array(ids[w]), pa.array(least[w]), part.column(0).take(pa.array(w))], names=["shard", "block", "qid", "least", "v"])

    asked = queries.select("v", "qid", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"))
    return asked.mapInArrow(run, "shard long, block long, qid long, least double, v array<double>")


def _searched(shards: DataFrame, routed: DataFrame, dim: int, k: int, factor: float) -> DataFrame:
    """(qid, vec_id, score): what each shard has for each query, k rows at most."""
    import pyarrow as pa

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        none = {"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not entries.num_rows or not asked.num_rows:
            return pa.table(none)
        qid = asked["qid"].to_numpy()
        a, b, s = Tree(_matrix(entries["v"], dim)).search(_matrix(asked["v"], dim), asked["least"].to_numpy(), k, factor)
        lists = entries["ids"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        n = np.diff(starts)[b]
        a, s = np.repeat(a, n), np.repeat(s, n)
        ids = flat[np.repeat(starts[:-1][b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((ids, -s, a))
        a, s, ids = a[order], s[order], ids[order]
        first = np.searchsorted(a, a, side="left")
        top = np.arange(len(a)) - first < k
        return pa.table({"qid": qid[a[top]], "vec_id": ids[top], "score": s[top]})

    sides = [d.groupBy("shard", "block") for d in (shards, routed)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "qid long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (a condition on vec_id) holds for, the k others of largest inner product.

    Rows with a null vec_id, and vectors that are null, empty, zero or hold nulls or non-finite numbers, take no part. A shorter vector
    counts as one with zeros at its end. Equal rows count once; rows of one id with other vectors are candidates of others, not of that
    id. Ties go to the smaller vec_id. Fewer candidates than k: all of them. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors)
    spare = _most_of_an_id(vectors, rows)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    entries = materialize(_entries(rows, k + spare), "vantage-entries")
    n_entries = entries.count()
    sample = np.array([r.v for r in entries.orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE).collect()], float).reshape(-1, dim)
    pivots = sample[: min(PIVOTS, part_rows(n_entries, SHARD))] if len(sample) else np.zeros((1, dim))
    celled = materialize(_cells(entries, pivots), "vantage-cells")
    stats = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.max("norm").alias("norm")).orderBy("cell").collect()  # PIVOTS rows at most
    cells = [(r.cell, part_rows(r.n, SHARD), r.r * (1 + SLACK), r.norm * (1 + SLACK)) for r in stats]
    parts = F.create_map(*[F.lit(x).cast("long") for c in cells for x in c[:2]])[F.col("cell")] if cells else F.lit(1).cast("long")
    asked = rows.where(is_query)
    queries = materialize(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "vantage-queries")
    blocks = part_rows(queries.count(), BLOCK)
    shard = F.shiftleft(F.col("cell"), 32) + F.pmod(F.xxhash64("ids"), parts)
    shards = celled.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "v", "ids")
    found = _searched(shards, _routed(queries, sample, pivots, cells, k + spare, factor, blocks), dim, k + spare, factor)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + spare)
    lists = materialize(top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "vantage-found")
    by_query = asked.join(queries, "v").select("vec_id", "qid").join(lists, "qid")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("vec_id")), 1, k)
    out = by_query.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    discard(celled)
    discard(entries)
    return out


def op11_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


#: The same rows by comparing each query with all.
SQL = f"""with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda s, x: s + x) as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
 select query_id, rank::int as rank, vec_id, score from r where rank <= {K}"""
