"""Publishing: refusals, failing writers, two writers, earlier versions; the store scan; limits that change in a stream; one order; digests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import align, chains, digests, glossary, limits, script
from loomtext.sources import publish

SEGMENTS = "path string, block_id string, part int, parts int, chunk_index int, state string, text string, final string"


@pytest.fixture
def project(spark):
    content = bytearray(b"One.\n\nTwo.")
    files = spark.createDataFrame([("a.md", content)], "path string, content binary")
    projects = spark.createDataFrame([("a.md", "SHA256:" + hashlib.sha256(content).hexdigest())], "path string, source_hash string")
    segs = [("a.md", "b1", None, None, 0, "done", "One.", "Jedan."), ("a.md", "b2", 1, 2, 0, "done", "Tw", "Dv"), ("a.md", "b2", 2, 2, 1, "failed", "o.", None)]
    return projects, files, spark.createDataFrame(segs, SEGMENTS)


def test_export_refuses_or_publishes(spark, project, tmp_path):
    projects, files, segments = project
    folder = f"file://{tmp_path}/out"
    with pytest.raises(publish.Refused, match="a.md: 1 untranslated blocks; failed: 1"):
        publish.export(segments, projects, files, folder)
    assert publish.versions(spark, folder) == []
    assert publish.export(segments, projects, files, folder, allow_partial=True) == 1
    assert [tuple(r) for r in publish.read(spark, folder).collect()] == [("a.md", "b1", "Jedan.")]
    whole = segments.withColumn("final", F.coalesce("final", F.lit("a.")))
    assert publish.export(whole, projects, files, folder) == 2
    assert publish.read(spark, folder).count() == 2 and publish.read(spark, folder, 1).count() == 1
    edited = files.withColumn("content", F.lit("Else").cast("binary"))
    with pytest.raises(publish.Refused, match="edited after"):
        publish.export(whole, projects, edited, folder)
    with pytest.raises(publish.Refused, match="gone"):
        publish.export(whole, projects, files.limit(0), folder)
    assert publish.current(spark, folder) == 2


def test_a_source_that_changes_during_the_write_stops_it(spark, project, tmp_path):
    projects, _, segments = project
    whole = segments.withColumn("final", F.coalesce("final", F.lit("a.")))
    source = tmp_path / "src" / "a.md"
    source.parent.mkdir()
    source.write_bytes(b"One.\n\nTwo.")
    files = spark.read.format("binaryFile").load(f"file://{source.parent}").select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")

    @F.udf("string")
    def touch(text):  # the writer's own rows change the source
        source.write_bytes(b"Other.")
        return text

    with pytest.raises(publish.Refused, match="edited after"):
        publish.export(whole.withColumn("final", touch("final")), projects, files, f"file://{tmp_path}/out")
    assert publish.versions(spark, f"file://{tmp_path}/out") == []
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".aside")]


def test_a_failing_writer_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert publish.publish(spark.range(3).toDF("n"), folder) == 1
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(bad, folder)

    def audit(rows):
        raise publish.Refused(f"{rows.count()} rows are too many")

    with pytest.raises(publish.Refused, match="5 rows"):
        publish.publish(spark.range(5).toDF("n"), folder, audit=audit)
    assert publish.versions(spark, folder) == [1] and publish.read(spark, folder).count() == 3
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".claims")) == ["v=00000001"]


def test_two_writers(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    publish.publish(spark.range(1).toDF("n"), folder)

    def other_first(rows):
        publish.replace_source(spark.range(7).toDF("n"), folder, based_on=1)

    with pytest.raises(publish.Conflict):
        publish.publish(spark.range(2).toDF("n"), folder, audit=other_first, based_on=1)
    assert publish.versions(spark, folder) == [1, 2] and publish.read(spark, folder).count() == 7
    (tmp_path / "t/.claims/00000003").touch()  # another one is at it
    with pytest.raises(publish.Conflict):
        publish.publish(spark.range(2).toDF("n"), folder)
    with pytest.raises(FileNotFoundError):
        publish.read(spark, folder, 9)


def test_store_scan(spark, tmp_path):
    texts = {"a": json.dumps({"id": "a", "updatedAt": "2024-01-02"}), "b": '{"id": "b", ', "c": "", "d": json.dumps({"id": "d"}), "e": json.dumps({"id": "e", "updatedAt": "2024-03-01", "other": [1]}, indent=1), "f": "﻿" + json.dumps({"id": "f", "updatedAt": "2024-02-01"})}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(text, encoding="utf-8")
    good, broken = publish.read_projects(spark, f"file://{tmp_path}/*/project.json", "id string, updatedAt string")
    assert [r.id for r in good.collect()] == ["e", "f", "a"]
    assert {r.file_path.split("/")[-2]: r.reason for r in broken.collect()}.keys() == {"b", "c", "d"}


# limits that change


REQUESTS = "id long, provider string, ts timestamp"
LIMITS = "provider string, ts timestamp, rpm int"


def _times(spark, rows, schema):
    cols = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'ts' else k}" for c, k in (x.split() for x in schema.split(", "))))
    return df.withColumn("ts", F.to_timestamp("ts")).select(cols)


def test_limits_in_force(spark):
    asked = _times(spark, [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 10:00:00"), (3, "a", "2024-01-05 00:00:00"), (4, "b", "2024-01-05 00:00:00"), (5, None, "2024-01-05 00:00:00"), (6, "a", None), (7, "a", "2024-01-01 09:59:59")], REQUESTS)
    changes = _times(spark, [("a", "2024-01-01 10:00:00", 5), ("a", "2024-01-02 10:00:00", 7), ("a", "2024-01-02 10:00:00", 6), ("b", "2024-01-06 00:00:00", 9), ("a", None, 1)], LIMITS)
    got = {r.id: r.rpm for r in limits.in_force(asked, changes, "provider", "ts", ["rpm"]).collect()}
    assert got == {1: None, 2: 5, 3: 7, 4: None, 5: None, 6: None, 7: None}
    assert limits.in_force(asked.limit(0), changes, "provider", "ts", ["rpm"]).collect() == []
    assert {r.rpm for r in limits.in_force(asked, changes.limit(0), "provider", "ts", ["rpm"]).collect()} == {None}


def test_limits_are_read_anew_for_each_batch(spark, tmp_path):
    table, source, out = (f"file://{tmp_path}/{n}" for n in ("limits", "in", "out"))
    _times(spark, [("a", "2024-01-01 00:00:00", 5)], LIMITS).write.parquet(table)

    def feed(rows):
        _times(spark, rows, REQUESTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        sink = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
        q = limits.with_live_limits(stream, lambda s: s.read.schema(LIMITS).parquet(table), "provider", "ts", ["rpm"], sink)
        q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    feed([(1, "a", "2024-01-02 00:00:00")])
    _times(spark, [("a", "2024-01-01 12:00:00", 3)], LIMITS).write.mode("append").parquet(table)
    feed([(2, "a", "2024-01-02 00:00:00"), (3, "a", "2024-01-01 11:00:00")])
    assert {r.id: (r.batch, r.rpm) for r in spark.read.parquet(out).collect()} == {1: (0, 5), 2: (1, 3), 3: (1, 5)}


# chains, orders, digests, passes, names


def test_chains_and_circles(spark, tmp_path):
    edges = [("a", "b"), ("b", "c"), ("c", "m/1"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s")] + [(f"n{i}", f"n{i + 1}") for i in range(40)]
    got = {r.alias: (r.target, r.steps, r.circular) for r in chains.resolved(spark.createDataFrame(edges, "alias string, target string"), f"file://{tmp_path}/c").collect()}
    assert got["a"] == ("m/1", 3, False) and got["c"] == ("m/1", 1, False) and got["n0"] == ("n40", 40, False)
    assert {k for k, v in got.items() if v[2]} == {"x", "y", "z", "s"} and got["x"][0] is None


def test_circles_take_no_rounds_once_chains_have_ended(spark, tmp_path):
    edges = [("x", "y"), ("y", "x"), ("a0", "x"), ("c0", "m")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 6)] + [(f"l{i}", "c5") for i in range(3000)]
    got = {r.alias: (r.target, r.steps, r.circular) for r in chains.resolved(spark.createDataFrame(edges, "alias string, target string"), f"file://{tmp_path}/c").collect()}
    assert [got[k] for k in ("x", "a0", "c0", "c5", "l7")] == [(None, None, True), (None, None, True), ("m", 1, False), ("m", 6, False), ("m", 7, False)] and len(got) == len(edges)
    stages = list((tmp_path / "c").iterdir())
    assert len(stages) <= 6 and sum(spark.read.parquet(f"file://{p}").count() for p in stages) <= 6 * 8


def test_shared_order_of_rows_taken_before(spark):
    def order(refs, rows):
        df = spark.createDataFrame([([(r, r.split("/")[0], r.startswith("c/")) for r in refs], [(r, r.split("/")[0]) for r in rows])], "refs array<struct<ref:string,kind:string,client:boolean>>, rows array<struct<ref:string,kind:string>>")
        return df.select(chains.shared_order(F.col("refs"), F.col("rows")).alias("o")).first().o

    assert order(["p/x", "p/1"], ["p/1", "q/1", "p/2"]) == ["p/x", "q/1", "p/1"]
    assert order(["p/2", "p/x"], ["p/1", "q/1", "p/2"]) == ["p/x", "q/1", "p/2"]
    assert order(["c/me", "role", "z/1", "p/x"], ["p/1", "q/1"]) == ["c/me", "p/x", "q/1", "role", "z/1"]
    assert order([], ["p/1"]) == ["p/1"] and order(["z/1", "z/1"], []) == ["z/1"]


def test_digests_of_many_batches(spark):
    rows = [(f"f{i % 3}", f"{i:04d}", "x" * (i % 50)) for i in range(900)] + [(None, "a", None), ("f9", "bé", "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.k: r.sha256 for r in digests.folder_digests(spark.createDataFrame(rows, "k string, name string, content string"), "k", "name", "content").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in {r[0] for r in rows}:
        h = hashlib.sha256()
        for _, n, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            h.update(n.encode() + b"\0" + (c or "").encode() + b"\0")
        want[k] = h.hexdigest()
    assert got == want


PASSES = "pass int, ord int, source string, target string, type string, gender string, note string, failed boolean"


def test_glossary_passes(spark):
    own = spark.createDataFrame([(0, "Ana", "Ana", "person", None, None)], "ord int, source string, target string, type string, gender string, note string")
    rows = [(1, 0, "Harbour", "luka", "Place", None, None, None), (2, 0, "harbour", "pristan", "term", "f", "old", False), (2, 1, " ANA", "Anica", "odd", "F", None, False), (3, 0, "Lost", "izgubljen", "term", None, None, True), (1, 1, "Mist", " ", "term", None, None, False)]
    got = {r.source: (r.added, r.target, r.gender, r.note, r.type) for r in glossary.merge_passes(own, spark.createDataFrame(rows, PASSES)).collect()}
    assert got == {"Ana": (0, "Ana", "f", None, "person"), "Harbour": (1, "luka", "f", "old", "place")}
    failed = spark.createDataFrame([(1, 0, "a", "b", "term", None, None, True)], PASSES)
    with pytest.raises(Exception, match="every glossary pass failed"):
        glossary.merge_passes(own, failed).collect()
    assert glossary.merge_passes(own, failed.limit(0)).count() == 1


def test_outer_commas_and_names(spark):
    cuts = {"a (b, (c, d), e), f": ["a (b, (c, d), e)", " f"], "a), b": ["a)", " b"], "": [""], "x (y, z": ["x (y, z"], ",": ["", ""]}
    df = spark.createDataFrame([(k,) for k in cuts], "t string")
    assert {r.t: r.c for r in df.select("t", script.outer_commas("t").alias("c")).collect()} == cuts
    names = {"ana": "Ivana", "ben": "B(en", "mr. x": "gospodin x"}
    lines = {"ANA: Hi, Ana.": ("IVANA: Hi, Ana.", None), "MR. X (low): So.": ("GOSPODIN X (low): So.", None), "BEN: No.": ("BEN: No.", "BEN"), "On screen: Ana (at the door, late), BEN": ("On screen: Ivana (at the door, late), BEN", "BEN"), "Ana walks.": ("Ana walks.", None), "TESTIMONY: ana": ("TESTIMONY: Ivana", None), "": ("", None)}
    df = spark.createDataFrame([(k, names) for k in lines], "line string, names map<string,string>")
    assert {r.line: (r.localized, r.kept) for r in script.localized_names(df, "line", "names").collect()} == lines


def test_refreshed_numbers_chunks_through(spark):
    old = [("d", i, f"t{i}", 1 + i // 2, "failed" if i > 5 else "done", f"x{i}", i in (1, 4)) for i in range(8)]
    new = [("d", 0, "t0", 1), ("d", 1, "new", 1), ("d", 2, "t1", 1), ("d", 3, "t2", 1), ("d", 4, "t3", 1), ("d", 5, "t6", 1)]
    at = [("d", 0, 0), ("d", 1, None), ("d", 2, 1), ("d", 3, 2), ("d", 4, 3), ("d", 5, 6)]
    old = spark.createDataFrame(old, "doc string, blk int, text string, chunk int, state string, final string, edited boolean")
    new = spark.createDataFrame(new, "doc string, blk int, text string, tokens int")
    at = spark.createDataFrame(at, "doc string, new_blk int, old_blk int")
    out = align.refreshed(new, old, at, "doc", 100)
    assert [(r.blk, r.from_chunk, r.chunk, r.state, r.final) for r in out.orderBy("blk").collect()] == [(0, 1, 1, "done", "x0"), (1, None, 2, "pending", None), (2, 1, 3, "done", "x1"), (3, 2, 4, "done", "x2"), (4, 2, 4, "done", "x3"), (5, None, 5, "pending", None)]
    assert tuple(align.refresh_report(out, old, at, "doc").first()) == ("d", 4, 2, 3, 5, 3, 1, 1)


def test_refresh_reports_move_digests_and_no_texts(spark):
    from loomtext.plans import runs

    old, new, _ = runs._refresh(spark, "/root/testdata/sf0.001", lambda text: F.unhex(F.sha2(text, 256)))
    assert {dict(x.dtypes)["text"] for x in (old, new)} == {"binary"} and dict(old.dtypes)["final"] == "binary"
    assert {r.n for x in (old, new) for r in x.select(F.octet_length("text").alias("n")).distinct().collect()} == {32}
