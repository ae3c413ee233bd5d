"""The project runner: faults of a model, stopping and going on, finished chunks."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.operators import runner, stages

SCHEMA = "doc string, idx int, state string, segs array<struct<id:string,text:string>>, final map<string,string>"


def chunk(doc, idx, n, state="pending", final=None):
    return (doc, idx, state, [(f"{doc}.{idx}.{i}", f"<1>A sentence of {doc} number {i} in chunk {idx}</1>") for i in range(n)], final or {})


def logged_model(folder):
    """Answers all but what its document is named for, and keeps each request as a file."""
    log = str(folder)

    def answer(request, model, task):
        import uuid
        from pathlib import Path

        Path(log, uuid.uuid4().hex).write_text(f"{model} {task}\n{request}")
        out = []
        segs = re.findall(r'<seg id="(.*?)">(.*?)</seg>', request)
        for k, (i, text) in enumerate(segs):
            doc = i.split(".")[0]
            if doc == "forgets" and k == len(segs) - 1 and len(segs) > 1:
                continue
            if doc == "never" and i.endswith(".0"):
                continue
            if doc == "second" and model == 0:
                text = text.replace("<1>", "")
            out.append(f'<seg id="{i}">Xx {text}</seg>')
        return "<think>hm</think>```\n" + "\n".join(out) + "\n```"

    return runner.from_function(answer)


def requests_in(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.fixture
def chunks(spark):
    rows = [chunk("good", 0, 5), chunk("good", 1, 1, "failed"), chunk("forgets", 0, 6), chunk("never", 0, 4), chunk("second", 0, 3, "reviewing"), chunk("old", 0, 2, "done", {"old.0.0": "kept"}), chunk("none", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_states_and_texts(spark, chunks, tmp_path):
    (tmp_path / "log").mkdir()
    out = {(r.doc, r.idx): r for r in runner.run(chunks, ["doc", "idx"], logged_model(tmp_path / "log"), 2, f"file://{tmp_path}/run").collect()}
    assert {k: (r.state, len(r.final), r.asks) for k, r in out.items()} == {("good", 0): ("done", 5, 1), ("good", 1): ("done", 1, 1), ("forgets", 0): ("done", 6, 2), ("never", 0): ("failed", 3, 5), ("second", 0): ("done", 3, 3), ("old", 0): ("done", 1, 0), ("none", 0): ("done", 0, 0)}
    assert out["old", 0].final == {"old.0.0": "kept"}
    assert out["forgets", 0].final["forgets.0.5"].startswith("Xx <1>")
    assert sum("The last answer was not usable" in t for t in requests_in(tmp_path / "log")) >= 3


@pytest.mark.parametrize("after", [1, 2, 3])
def test_a_stopped_run_goes_on_and_asks_nothing_twice(spark, chunks, tmp_path, after):
    for name in ("whole", "log"):
        (tmp_path / name).mkdir()
    want = runner.run(chunks, ["doc", "idx"], logged_model(tmp_path / "whole"), 2, f"file://{tmp_path}/a").collect()
    model, path = logged_model(tmp_path / "log"), f"file://{tmp_path}/b"
    assert runner.run(chunks, ["doc", "idx"], model, 2, path, most_rounds=after) is None
    before = requests_in(tmp_path / "log")
    assert before
    got = runner.run(chunks, ["doc", "idx"], model, 2, path).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert requests_in(tmp_path / "log") == requests_in(tmp_path / "whole")
    runner.run(chunks, ["doc", "idx"], model, 2, path).collect()
    assert requests_in(tmp_path / "log") == requests_in(tmp_path / "whole")


def test_a_half_written_round_is_made_anew(spark, chunks, tmp_path):
    (tmp_path / "log").mkdir()
    model, path = logged_model(tmp_path / "log"), f"file://{tmp_path}/b"
    runner.run(chunks, ["doc", "idx"], model, 2, path, most_rounds=2)
    (tmp_path / "b/translate/round=1/_SUCCESS").unlink()
    assert not stages.is_committed(spark, f"{path}/translate/round=1")
    states = {r.doc: r.state for r in runner.run(chunks, ["doc", "idx"], model, 2, path).collect()}
    assert states["never"] == "failed" and states["second"] == "done"


def test_mending_takes_only_answers_that_hold(spark, tmp_path):
    same = "<1>These words come back as they are</1>"
    rows = [("a", 0, "pending", [("a.0", same), ("a.1", "<1>short</1>")], {}), ("b", 0, "pending", [("b.0", same)], {}), ("c", 0, "pending", [("c.0", same)], {})]

    def answer(request, model, task):
        doc = re.search(r'id="(.)', request)[1]
        if task == "translate":
            return request
        return re.sub(r"<1>(.*)</1>", {"a": r"<1>Ove \1</1>", "b": r"Ove \1", "c": r"<1>\1</1>"}[doc], request)

    out = {r.doc: r for r in runner.run(spark.createDataFrame(rows, SCHEMA), ["doc"], runner.from_function(answer), 1, f"file://{tmp_path}/r").collect()}
    assert {k: (r.state, r.asks) for k, r in out.items()} == {"a": ("done", 2), "b": ("flagged", 2), "c": ("flagged", 2)}
    assert out["a"].final == {"a.0": "<1>Ove These words come back as they are</1>", "a.1": "<1>short</1>"} and out["b"].final["b.0"] == same


def test_no_chunks(spark, tmp_path):
    assert runner.run(spark.createDataFrame([], SCHEMA), ["doc", "idx"], runner.from_function(lambda r, m, t: r), 1, f"file://{tmp_path}/r").collect() == []


def test_columns_of_a_round(spark):
    rows = spark.createDataFrame([([("a", "<1>x</1>"), ("b", "y")], 0, 1, 0, '<seg id="a">x</seg><seg id="b">z</seg>')], "segs array<struct<id:string,text:string>>, model int, wrong int, follow int, reply string")
    r = runner.decide(rows, 1).first()
    assert r.outcome == "salvaged" and r.found == {"b": "z"} and [s.id for s in r.next[0].segs] == ["a"]
    r = runner.decide(rows.withColumn("reply", F.lit("")), 1).first()
    assert r.outcome == "halved" and [[s.id for s in a.segs] for a in r.next] == [["a"], ["b"]]


def test_rounds_hold_what_was_found_and_chunks_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "pending", [("a.0", "one two")], {})], SCHEMA)
    path = f"file://{tmp_path}/r"
    assert [(r.state, r.final) for r in runner.run(rows, ["doc"], runner.from_function(lambda r, m, t: r.replace("one", "uno")), 1, path).collect()] == [("done", {"a.0": "uno two"})]
    assert set(spark.read.parquet(f"{path}/translate/round=0").columns) == {"doc", "outcome", "found", "next"}
    assert stages.is_committed(spark, f"{path}/chunks") and not stages.is_committed(spark, f"{path}/final")


def test_requests_of_one_file_are_many_tasks(spark, tmp_path):
    asks = spark.range(200).coalesce(1).selectExpr("id", "cast(id as string) as request")
    out = runner.answers(asks, ["id"], {"type": "object"}, lambda request, n, task: F.concat(F.lit('{"x": '), request, F.lit("}")), f"file://{tmp_path}/r")
    assert {(r.id, r.json, r.asks) for r in out.collect()} == {(i, f'{{"x": {i}}}', 1) for i in range(200)}
    assert len(list((tmp_path / "r/asked").glob("part-*.parquet"))) > 1
