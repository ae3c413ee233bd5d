"""Valid-time enrichment of sales by event-time timers (operator 12).

Both tables are cut into batches, written to the shared folder and fed, batch after batch, to one stateful streaming query that is
started anew for each on the same checkpoint. Each table has a watermark of its own: every row of a batch carries the table's
largest time up to that batch as its event time, so no row is ever late for Spark, and Spark's minimum of both marks, less the delay, is
the horizon H. A key waits with a timer at the first time at which it has something to do: release a waiting sale or prune a version.

Keys: clients are dealt by hash into buckets, worked on as arrays. A client with many rows is cut into slots of time, each a key of
its own, so neither its sales nor its versions meet in one task. A slot answers from its own versions and says how many it holds,
which is its last and which it would keep below H; the sales of such clients take what lies in earlier slots from these few rows,
by a join on (client, batch, slot) after the stream.

Spark's watermark counts milliseconds. The event time is the table's largest time, rounded up, plus a millisecond for each batch; so
a timer is never late, and what it does is decided by microseconds of H, which are known from the same largest times. The clock must
agree with them, else the query fails.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, new_path, table

#: Batches, the day (since 1970) of the first and how many days there are; the watermarks' delay in microseconds.
BATCHES, FIRST_DAY, DAYS = 10, 19723, 152
DELAY = 36 * 3600 * 10**6
#: About so many rows of all batches belong to a key; a client with more than HOT_ROWS is cut into slots.
KEY_ROWS, HOT_ROWS = 20_000, 50_000
#: Quantiles of a hot client's times between which its slots are cut evenly.
QUANTILES = 256
#: A missing number.
NONE = -(2**63)
#: The clock of timers runs from 1970 to 2261.
FIRST_MS, LAST_MS = 1, 9_183_000_000_000
SALE, CHANGE, TICK = 0, 1, 2
FEED = "kind int, bucket long, slot long, client long, id long, t long, seq long, cents long, op string, event timestamp"
STATE = "versions binary, waiting binary"
VERSION = ("client", "t", "seq", "id", "cents", "op", "old")
OUT = "rec string, client long, slot long, id long, batch long, n long, sold long, v_t long, v_seq long, v_id long, v_cents long, v_op string"


def _micros(c):
    """Microseconds since 1970 of a time without a zone, NONE for null; no session zone has a say."""
    c = c.cast("timestamp_ntz")
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.coalesce((days * 86_400 + clock.cast("long")) * 1_000_000 + micros, F.lit(NONE))


def _batch(day):
    """Number of a batch; what is earlier than the first day comes with batch 0, a null day with the last one."""
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def _day(c):
    return F.datediff(c.cast("timestamp_ntz").cast("date"), F.lit("1970-01-01").cast("date"))


def _number(c):
    return F.coalesce(c.cast("long"), F.lit(NONE))


def _sales(sales: DataFrame) -> DataFrame:
    s = sales
    return s.select(
        _batch(_day(s["arrived_at"])).alias("batch"), F.lit(SALE).alias("kind"), s["client_id"].cast("long").alias("client"), _number(s["sale_id"]).alias("id"), _micros(s["sold_at"]).alias("t"),
        F.lit(NONE).alias("seq"), F.lit(NONE).alias("cents"), F.lit(None).cast("string").alias("op"),
    )


def _changes(changes: DataFrame) -> DataFrame:
    c = changes.where("valid_at is not null").distinct()
    shift = F.crc32(F.coalesce(c["change_id"].cast("string"), F.lit("")).cast("binary")) % 4
    cents = F.floor(100 * c["balance"].cast("double") + 0.5)
    return c.select(
        _batch(_day(c["valid_at"]) + shift).alias("batch"), F.lit(CHANGE).alias("kind"), c["client_id"].cast("long").alias("client"), _number(c["change_id"]).alias("id"), _micros(c["valid_at"]).alias("t"),
        _number(c["seq"]).alias("seq"), _number(cents).alias("cents"), c["op"].cast("string").alias("op"),
    )


def _hot(rows: DataFrame) -> DataFrame:
    """(client, cuts, parts): quantiles of the times of clients with more than HOT_ROWS rows, and slots between two of them."""
    many = rows.where("client is not null").groupBy("client").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    many = materialize(many, "timers-many")  # of known size: a small one is sent to the rows, which so stay where they are
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    timed = rows.where(F.col("t") > NONE).select("client", "t").join(many, "client")
    return timed.groupBy("client", "n").agg(F.percentile_approx("t", shares, 10_000).alias("cuts")).select("client", "cuts", F.ceil(F.col("n") / KEY_ROWS / QUANTILES).cast("long").alias("parts"))


def _keyed(rows: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """rows with bucket and slot. A null client is nobody: its rows go by their own id. slot is -1 but for hot clients; it rises with t."""
    cut = F.col("cuts")
    at = F.greatest(F.lit(1), F.least(F.lit(QUANTILES), F.size(F.filter(cut, lambda c: c <= F.col("t")))))
    low, high = F.element_at(cut, at), F.element_at(cut, at + 1)
    inside = F.floor((F.col("t") - low) / F.greatest(high - low + 1, F.lit(1)) * F.col("parts"))
    timed = at * F.col("parts") + F.greatest(F.lit(0), F.least(F.col("parts") - 1, inside))
    slot = F.when(F.col("t") == NONE, F.pmod(F.xxhash64("id"), QUANTILES * F.col("parts"))).otherwise(timed)
    rows = rows.join(hot, "client", "left")
    dealt = F.pmod(F.xxhash64(F.coalesce("client", "id")), F.lit(buckets))
    is_hot = F.col("cuts").isNotNull()
    return rows.withColumn("bucket", F.when(is_hot, F.col("client")).otherwise(dealt)).withColumn("slot", F.when(is_hot, slot).otherwise(-1).cast("long")).drop("cuts", "parts")


def _packed(rows: dict) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.record_batch({k: pa.array(v, pa.string()) if k == "op" else pa.array(v) for k, v in rows.items()})
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob, names) -> dict:
    import pyarrow as pa

    if blob is None:
        return {n: np.zeros(0, object if n == "op" else bool if n == "old" else np.int64) for n in names}
    got = pa.ipc.open_stream(blob).read_all()
    return {n: got[n].to_numpy(zero_copy_only=False) for n in names}


def _only(rows: dict, at) -> dict:
    return {k: v[at] for k, v in rows.items()}


def _both(a: dict, b: dict) -> dict:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


def last_versions(versions: dict, clients: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each (client, time) the index of the last of the versions, which are in (client, t, seq, id) order, with t at most the time;
    -1: none, or no time."""
    n, m = len(versions["t"]), len(times)
    client, t = np.concatenate([versions["client"], clients]), np.concatenate([versions["t"], times])
    order = np.lexsort((np.repeat([0, 1], [n, m]), t, client))  # stable: versions of one time stay in order, before the sales of it
    seen = np.maximum.accumulate(np.where(order < n, order, -1)) if n else np.full(n + m, -1)
    out = np.full(n + m, -1)
    out[order] = seen
    found = out[n:]
    ok = (found >= 0) & (times != NONE)
    ok[ok] = versions["client"][found[ok]] == clients[ok]
    return np.where(ok, found, -1)


def key_step(bucket: int, slot: int, versions: dict, waiting: dict, rows: dict, batch: int, late_below: int | None, horizon: int | None, final: bool):
    """One batch of one key: (output columns, versions, waiting, first microsecond H must pass for the key to have work, or None)."""
    out = []

    def put(rec, client, ids, n=NONE, sold=NONE, version=None, at=batch):
        size = len(ids)
        full = lambda x: x if isinstance(x, np.ndarray) else np.full(size, x, np.int64)
        v = version or {k: NONE for k in VERSION} | {"op": np.full(size, None, object)}
        out.append((np.full(size, rec, object), full(client), full(slot), full(ids), full(at), full(n), full(sold), full(v["t"]), full(v["seq"]), full(v["id"]), full(v["cents"]), v["op"]))

    changes = _only(rows, rows["kind"] == CHANGE)
    is_late = changes["t"] < late_below if late_below is not None else np.zeros(len(changes["t"]), bool)
    put("late", NONE, changes["id"][is_late])
    fresh = _only(changes, ~is_late & (changes["client"] != NONE))
    versions = _both(versions, {k: fresh[k] for k in VERSION[:-1]} | {"old": np.zeros(len(fresh["t"]), bool)})
    order = np.lexsort((versions["id"], versions["seq"], versions["t"], versions["client"]))
    versions = _only(versions, order)

    def summary(at, said):  # for the sales of batch `at`; the larger `said` holds
        for rec, of in (("new", np.flatnonzero(~versions["old"])), ("old", np.flatnonzero(versions["old"]))):
            put(rec, bucket, np.zeros(1, np.int64), len(of), said, _only(versions, of[-1:]) if len(of) else None, at)

    if slot >= 0:
        summary(batch, 1)
    sales = _only(rows, rows["kind"] == SALE)
    sales = _both(waiting, {k: sales[k] for k in ("client", "id", "t")})
    due = (sales["t"] == NONE) | np.full(len(sales["t"]), final)
    if horizon is not None:
        due |= sales["t"] < horizon
    told, waiting = _only(sales, due), _only(sales, ~due)
    usable = _only(versions, ~versions["old"]) if slot >= 0 else versions
    at = last_versions(usable, told["client"], told["t"])
    got = {k: np.where(at >= 0, np.append(usable[k], None if k == "op" else NONE)[at], None if k == "op" else NONE) for k in VERSION[:-1]}
    clients, counts = np.unique(versions["client"], return_counts=True)
    spot = np.searchsorted(clients, told["client"])
    held = np.where(np.append(clients, NONE)[spot] == told["client"], np.append(counts, 0)[spot], 0)
    held[told["client"] == NONE] = 0
    put("sale", told["client"], told["id"], held.astype(np.int64), told["t"], got)

    nxt = []
    if horizon is not None and len(versions["t"]):
        below = versions["t"] <= horizon
        last = np.ones(len(below), bool)
        last[:-1] = (versions["client"][1:] != versions["client"][:-1]) | ~below[1:]
        versions = _only(versions, ~below | last) | {"old": below[~below | last]}
        if slot >= 0:
            summary(batch + 1, 0)
    if len(waiting["t"]):
        nxt.append(int(waiting["t"].min()))
    first = np.ones(len(versions["t"]), bool)
    first[1:] = versions["client"][1:] != versions["client"][:-1]
    later = versions["t"][~versions["old"] & (~first | (slot >= 0))]  # a client's only version is kept wherever H is
    if len(later):
        nxt.append(int(later.min()))
    return tuple(np.concatenate(c) for c in zip(*out)), versions, waiting, min(nxt, default=None)


def _stateful(batch: int, late_below: int | None, horizon: int | None, clock: int, final: bool):
    """The function of a start: accepts the batch's changes, releases what is due by H, prunes, and sets the key's timer."""

    def step(key, frames, state):
        import pandas as pd

        now = state.getCurrentWatermarkMs()
        if now != clock:
            raise ValueError(f"batch {batch}: the watermark is {now}, not {clock}")
        timed_out = state.hasTimedOut
        names = ("kind", "client", "id", "t", "seq", "cents", "op")
        parts = [] if timed_out else [f[list(names)] for f in frames]
        frame = pd.concat(parts) if parts else None
        rows = {n: (frame[n].to_numpy() if frame is not None else np.zeros(0, object if n == "op" else np.int64)) for n in names}
        if key[1] < 0 and not timed_out and (rows["kind"] == TICK).all() and not state.exists:
            return
        blobs = state.get if state.exists else (None, None)
        versions, waiting = _unpacked(blobs[0], VERSION), _unpacked(blobs[1], ("client", "id", "t"))
        out, versions, waiting, due = key_step(int(key[0]), int(key[1]), versions, waiting, rows, batch, late_below, horizon, final)
        state.update((_packed(versions), _packed(waiting)))
        if due is not None:
            state.setTimeoutTimestamp(max(now, FIRST_MS, min(due // 1000 - 1, LAST_MS - DELAY // 1000 - 1)))
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(dict(zip(names, out)))

    return step


def _after(mark: int | None, batch: int) -> int:
    """Milliseconds of the event time of a batch whose table's largest time so far is mark; its watermark is above 0."""
    return max(DELAY // 1000 + FIRST_MS, min(-(-mark // 1000), LAST_MS)) + batch


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, a: str, b: str) -> bool:
    """Moves folder a to b, if there is one."""
    (source, fs), (target, _) = _fs(spark, a), _fs(spark, b)
    if not fs.exists(source):
        return False
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"cannot move {a} to {b}")
    return True


def _streamed(spark: SparkSession, base: str, batch: int, late_below, horizon, clock: int) -> None:
    """One start of the streaming query: the files moved in since the last one are one micro-batch."""
    feeds = []
    for name in ("sales", "changes"):
        feed = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(f"{base}/in/{name}")
        feeds.append(feed.withWatermark("event", f"{DELAY // 10**6} seconds"))
    step = _stateful(batch, late_below, horizon, clock, batch == BATCHES)
    out = feeds[0].union(feeds[1]).groupBy("bucket", "slot").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.multipleWatermarkPolicy": "min"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        run = out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()


def _time(ms: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def _marks(spark: SparkSession, rows: DataFrame) -> list[int | None]:
    """For each batch the largest time up to it, None before the first."""
    most = {r.batch: r.t for r in rows.groupBy("batch").agg(F.max("t").alias("t")).collect()}  # BATCHES rows at most
    out, now = [], None
    for b in range(BATCHES):
        t = most.get(b)
        if t is not None and t != NONE:
            now = t if now is None else max(now, t)
        out.append(now)
    return out


def fed(spark: SparkSession, sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Runs the stream over both tables; its output rows (OUT) as a table."""
    bounded_batches(spark)
    base = new_path(spark, "timers")
    cols = [c.split()[0] for c in FEED.split(", ")]
    sides = {"sales": _sales(sales), "changes": _changes(changes)}
    raw = {"sales": sides["sales"], "changes": _changes_times(changes)}
    both = raw["sales"].select("client", "t").union(raw["changes"].select("client", "t"))
    hot = materialize(_hot(both), "timers-hot")
    buckets = max(1, -(-both.count() // KEY_ROWS))
    marks = {name: _marks(spark, raw[name]) for name in raw}
    for name, rows in sides.items():
        known = [b for b in range(BATCHES + 1) if marks[name][min(b, BATCHES - 1)] is not None]
        events = spark.createDataFrame([(b, _time(_after(marks[name][min(b, BATCHES - 1)], b))) for b in known], "batch int, event timestamp")  # BATCHES + 1 rows
        rows = _keyed(rows, hot, buckets).withColumn("client", _number(F.col("client")))
        tick = events.select("batch", F.lit(TICK).alias("kind"), F.lit(-1).cast("long").alias("client"), *(F.lit(NONE).alias(c) for c in ("id", "t", "seq", "cents")), F.lit(None).cast("string").alias("op"), *(F.lit(-1).cast("long").alias(c) for c in ("bucket", "slot")))
        feed = rows.unionByName(tick).join(F.broadcast(events), "batch", "left")
        feed.select("batch", *cols).write.partitionBy("batch").parquet(f"{base}/feed/{name}")
    # the last start calls every key: what waits still goes out
    own = [spark.read.schema(f"{FEED}, batch int").parquet(f"{base}/feed/{name}").where(F.col("kind") != TICK).select("bucket", "slot") for name in sides]
    rest = own[0].union(own[1]).distinct().select(
        F.lit(TICK).alias("kind"), "bucket", "slot", *(F.lit(NONE).alias(c) for c in ("client", "id", "t", "seq", "cents")), F.lit(None).cast("string").alias("op"), F.lit(_time(_after(marks["sales"][-1] or 0, BATCHES))).alias("event")
    )
    rest.select(*cols).write.parquet(f"{base}/last")
    for name in sides:
        _fs(spark, f"{base}/in/{name}")[1].mkdirs(_fs(spark, f"{base}/in/{name}")[0])
    clock = 0
    for b in range(BATCHES + 1):
        moved = [_move(spark, f"{base}/feed/{name}/batch={b}", f"{base}/in/{name}/b{b}") for name in sides]
        if b == BATCHES:
            moved.append(_move(spark, f"{base}/last", f"{base}/in/sales/last"))
        if not any(moved):
            continue
        before = {name: marks[name][b - 1] if b else None for name in sides}
        late = None if before["changes"] is None else before["changes"] - DELAY
        horizon = None if None in before.values() else min(before.values()) - DELAY
        if horizon is not None:
            clock = min(_after(m, b - 1) for m in before.values()) - DELAY // 1000
        _streamed(spark, base, b, late, horizon, clock)
    discard(hot)
    for done in ("feed", "in", "checkpoint"):
        p, fs = _fs(spark, f"{base}/{done}")
        fs.delete(p, True)
    p, fs = _fs(spark, f"{base}/out")
    return spark.read.schema(OUT).parquet(f"{base}/out") if fs.exists(p) else spark.createDataFrame([], OUT)


def _changes_times(changes: DataFrame) -> DataFrame:
    """(batch, client, t) of the changes, repeated ones included: enough for largest times and shares."""
    c = changes.where("valid_at is not null")
    shift = F.crc32(F.coalesce(c["change_id"].cast("string"), F.lit("")).cast("binary")) % 4
    return c.select(_batch(_day(c["valid_at"]) + shift).alias("batch"), c["client_id"].cast("long").alias("client"), _micros(c["valid_at"]).alias("t"))


def _slots(out: DataFrame) -> DataFrame:
    """(client, batch, slot, n_held, carried, kept) for each batch from a slot's first: the client's versions, the last newer than H in
    earlier slots, and the one that is kept below H."""
    version = F.struct(*(F.col(c) for c in ("v_t", "v_seq", "v_id", "v_cents", "v_op")))
    said = out.where("rec in ('new', 'old')")  # of one batch, what was said before its sales counts, not what the batch before left
    here = said.groupBy("client", "slot", "batch", "rec").agg(F.max_by(F.struct("n", F.when(F.col("v_t") > NONE, version).alias("v")), "sold").alias("is"))
    here = here.groupBy("client", "slot", "batch").agg(*(F.first(F.when(F.col("rec") == r, F.col("is")), True).alias(r) for r in ("new", "old")))
    along = Window.partitionBy("client", "slot").orderBy("batch")
    grid = here.groupBy("client", "slot").agg(F.min("batch").alias("b")).select("client", "slot", F.explode(F.sequence("b", F.lit(BATCHES).cast("long"))).alias("batch"))
    rows = grid.join(here, ["client", "slot", "batch"], "left").select("client", "slot", "batch", *(F.last(c, True).over(along).alias(c) for c in ("new", "old")))
    whole = Window.partitionBy("client", "batch")
    before = whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.max("old.v").over(whole)
    return rows.select("client", "slot", "batch", (F.sum("new.n").over(whole) + kept.isNotNull().cast("long")).alias("n_held"), F.max("new.v").over(before).alias("carried"), kept.alias("kept"))


def enriched(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op) of every sale and every late change, see the module.

    Changes without valid_at take no part; repeated changes count once, repeated sales as often as they occur. A null client_id is
    nobody: its sales have no versions. A null arrived_at comes with the last batch, as least() passes over nulls; what is earlier than the first day with batch 0. A null seq or
    change_id is the smallest. A sale without sold_at goes out in its own batch without a version. Extra columns count for telling
    repeated changes apart and are ignored otherwise. Empty tables give an empty result.
    """
    spark = sales.sparkSession
    out = fed(spark, sales, changes)
    plain = out.where("rec in ('sale', 'late') and slot < 0").select("rec", "id", "batch", "n", "v_t", "v_id", "v_cents", "v_op")
    hot_late = out.where("rec = 'late' and slot >= 0").select(*plain.columns)
    told = out.where("rec = 'sale' and slot >= 0")
    version = F.when(F.col("v_t") > NONE, F.struct("v_t", "v_seq", "v_id", "v_cents", "v_op"))
    hot = told.join(_slots(out), ["client", "slot", "batch"], "left")
    in_time = (F.col("sold") > NONE) & (F.col("kept.v_t") <= F.col("sold"))
    best = F.greatest(version, F.when(F.col("sold") > NONE, F.col("carried")), F.when(in_time, F.col("kept")))
    hot = hot.withColumn("best", best).select("rec", "id", "batch", F.coalesce("n_held", F.lit(0)).alias("n"), F.coalesce("best.v_t", F.lit(NONE)).alias("v_t"), *(F.col(f"best.{c}").alias(c) for c in ("v_id", "v_cents", "v_op")))
    rows = plain.unionByName(hot).unionByName(hot_late)
    is_sale, known = F.col("rec") == "sale", lambda c: F.when(F.col(c) > NONE, F.col(c))
    has = is_sale & (F.col("v_t") > NONE)
    return rows.select("rec", known("id").alias("id"), "batch", F.when(is_sale, F.col("n")).alias("n_held"), F.when(has, known("v_id")).alias("change_id"), F.when(has, known("v_cents")).alias("balance_cents"), F.when(has, F.col("v_op")).alias("op"))


def op12_valid_time_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


_CUT = f"least({BATCHES - 1}, floor(({{}} - {FIRST_DAY}) * {BATCHES} / {DAYS}.0))::bigint"
_TEXT_CRC = "xor(4294967295, list_reduce(list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, (i + 1)::int, 2))::bigint), lambda s, b: xor(s >> 8, list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), xor(s & 255, b))), 4294967295))"
#: The same rows without a stream: batches, marks and what each batch holds in closed form.
SQL = f"""with s as (select sale_id, client_id, sold_at, greatest(0, {_CUT.format("date_diff('day', date '1970-01-01', arrived_at::date)")}) as b from sales),
 d as (select *, hex(encode(change_id::varchar)) as x from (select distinct * from client_changes where valid_at is not null)),
 c as (select *, greatest(0, {_CUT.format(f"date_diff('day', date '1970-01-01', valid_at::date) + {_TEXT_CRC} % 4")}) as b from d),
 k as (select unnest(range({BATCHES + 1})) as k),
 m as (select k, (select max(sold_at) from s where b < k) - interval 36 hour as ws, (select max(valid_at) from c where b < k) - interval 36 hour as wc from k),
 h as (select k, wc, case when ws is not null and wc is not null then least(ws, wc) end as h from m),
 late as (select change_id, b from c join h on h.k = c.b where valid_at < wc),
 v as (select c.client_id, c.change_id, c.valid_at, c.seq, c.op, floor(100 * c.balance + 0.5)::bigint as cents, c.b from c join h on h.k = c.b where wc is null or valid_at >= wc),
 u as (select v.*, h.k, (select h from h as g where g.k = h.k - 1) as gone from v join h on v.b <= h.k),
 o as (select *, row_number() over (partition by k, client_id, b < k and valid_at <= gone order by valid_at desc, seq desc, change_id desc) as r from u),
 held as (select * from o where gone is null or b = k or valid_at > gone or r = 1),
 e as (select sale_id, client_id, sold_at, coalesce((select min(k) from h where k >= b and k < {BATCHES} and (sold_at is null or sold_at < h)), {BATCHES}) as k from s),
 n as (select client_id, k, count(*) as n from held group by all),
 a as (select e.*, row_number() over () as row from e),
 j as (select a.row, arg_max(struct_pack(change_id := held.change_id, cents := held.cents, op := held.op), (held.valid_at, held.seq, held.change_id)) as w from a join held on held.client_id = a.client_id and held.k = a.k and held.valid_at <= a.sold_at group by a.row)
 select 'sale' as rec, a.sale_id as id, a.k as batch, coalesce(n.n, 0) as n_held, w.change_id as change_id, w.cents as balance_cents, w.op as op from a left join n on n.client_id = a.client_id and n.k = a.k left join j on j.row = a.row
 union all select 'late', change_id, b, null, null, null, null from late"""
