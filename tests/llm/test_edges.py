"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing extra columns and empty tables."""

import random

import pytest

from loomtext.llm import chat, decontamination, html, packing, pii, ppm, quality, records, sharding, simhash
from loomtext.llm.common import new_path

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, None, 1, "x"),
    (2, "", 1, "x"),
    (3, LONG, 1, "x"),
    (4, "Some words that are here for all to see and read today.", 1, "x"),
    (4, "Some words that are here for all to see and read today.", 1, "x"),
    (None, "Some words that are here for all to see and read today.", 1, "x"),
    (None, None, None, None),
    (5, " \t\n\r ", 1, "x"),
    (6, "ümlaut 日本語 😀 \x00 \x85 end", 1, "x"),
    (-7, "one", 1, "x"),
]
# extra columns that clash with names that operators use inside
SCHEMA = "doc_id long, text string, fp long, block string"
CLASH = [("length", "item"), ("_id", "_chunk"), ("component_id", "rank"), ("pattern", "kept")]

OPERATORS = {
    "op1": (ppm.scored, True),
    "op2": (sharding.sharded, True),
    "op3": (pii.detected, True),
    "op4": (quality.judged, True),
    "op5": (None, False),
    "op7": (packing.packed, False),
    "op9": (lambda df: records.read_back(records.written(df, new_path(df.sparkSession, "t"))), True),
    "op10": (simhash.near_duplicates, True),
}


def bench(spark):
    return spark.createDataFrame([(1, "words that are here for all to see"), (2, None), (3, ""), (None, "one"), (1, "words that are here for all to see")], "item_id long, text string")


OPERATORS["op5"] = (lambda df: decontamination.contaminated(df, bench(df.sparkSession)), False)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, name):
    run, one_each = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = run(docs).collect()
    assert got
    if one_each:
        assert len(got) == len(ROWS)
        assert sum(r.doc_id is None for r in got) == 2
        assert sum(r.doc_id == 4 for r in got) == 2


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    run, _ = OPERATORS[name]
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("a,b", CLASH)
def test_stages_keep_clashing_columns(spark, a, b):
    docs = spark.createDataFrame([(1, "Some words that are here for all to see and read today.", 5, 6)], f"doc_id long, text string, {a} long, {b} long")
    for stage in (quality.accepted, simhash.deduplicated, lambda d: decontamination.cleaned(d, bench(spark).where("item_id = 3")), pii.redacted):
        out = stage(docs)
        assert out.columns == docs.columns
        assert len(out.collect()) <= 1


def test_stages_judge_each_row(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}n" for _ in range(n))
    a, b, c, d = (words(120) + "." for _ in range(4))
    item = " ".join(b.split()[20:60])
    docs = spark.createDataFrame([(None, a), (None, b), (None, a), (None, None), (7, c), (7, d), (7, c)], "doc_id long, text string")
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)
    assert seen(simhash.deduplicated(docs)) == want((None, a), (None, b), (None, None), (7, c), (7, d))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert seen(decontamination.cleaned(docs, items)) == want((None, a), (None, a), (None, None), (7, c), (7, d), (7, c))
    judged = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame([(i, r.text) for i, r in enumerate(docs.collect())], "doc_id long, text string")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert not judged[3] and any(judged.values())
    assert seen(quality.accepted(docs)) == want(*(r for i, r in enumerate(rows) if judged[i]))


def test_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>" * 3000 + "x", 1), (4, "u", "<article><p>A text that says it. And more of it.</p></article>", 1), (4, "u", "<a <b <c", 1)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(got) == 5
    assert {r.text for r in got if r.page_id == 4} >= {"A text that says it. And more of it."}
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_conversations(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (None, 0, "assistant", ""), (2, None, "assistant", LONG)]
    got = {r.conv_id: r for r in chat.formats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert got[2].loss_chars == len(LONG)
    assert chat.formats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
