"""Blocks leave a task in bounded batches: not every file of an Arrow batch is read before the first block goes out."""

import pyarrow as pa

from loomtext.sources import blocks, epub, markdown, markup


def test_text_blocks_go_out_while_files_are_read():
    texts = [f"# Title {n}\n\n{'line ' * 4000}\n\n* item\n" for n in range(400)]
    read = 0

    def reader(text):
        nonlocal read
        read += 1
        return markdown.rows_of(text, True)

    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 400)], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out, read_at, most = [], [], 0
    for b in blocks.batches_of([batch], reader, markdown.COLUMNS):
        read_at.append(read)
        most = max(most, b.nbytes)
        out += b.to_pylist()
    assert read_at[0] < 150 and read_at[-1] == 400 and most < 2 * blocks.BATCH_BYTES
    assert out == [{"doc_id": n or None} | r for n, t in enumerate(texts) for r in markdown.rows_of(t, True)]


def test_many_short_blocks_are_bounded_too():
    page = f"<body>{'<p>a <b>b</b></p>' * 25_000}</body>"
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([page])], names=["page_id", "html"])
    out = list(blocks.batches_of([batch], markup.rows_of, markup.COLUMNS))
    assert sum(b.num_rows for b in out) == 25_000 and max(b.num_rows for b in out) <= blocks.BATCH_ROWS
    assert out[-1].to_pylist()[-1] == {"page_id": 7, "blk_ord": 25_000, "block_id": "d1.25000", "kind": "para", "text": "a <1>b</1>", "tags": [{"n": 1, "kind": "pair", "data": '{"attrs": {}, "name": "b"}'}]}


def test_keys_pass_as_they_are(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "a\n\nb"), (None, "c"), (2, None), (3, "\n")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.blk_ord, r.text, r.title) for r in markdown.read_blocks(docs, True).collect()) == [(0, 1, "c", None), (big, 1, "a", None), (big, 2, "b", None)]
    assert markdown.read_blocks(docs.limit(0), True).collect() == []


def test_blocks_of_one_book_at_a_time(spark):
    class Row(dict):
        alive = 0

        def __init__(self, *a):
            super().__init__(*a)
            Row.alive += 1

        def __del__(self):
            Row.alive -= 1

    def reader(data):
        return [Row({"sec_ord": Row.alive, "section": None, "blk_ord": n, "block_id": f"d1.{n}", "kind": "para", "text": data.decode() * 2000, "tags": []}) for n in range(10)]

    files = spark.range(0, 400, 1, 1).selectExpr("cast(id as string) as path", "cast('x' as binary) as content")
    got = epub.read_blocks(files, reader).selectExpr("count(*) as n", "max(sec_ord) as alive", "sum(length(text)) as chars").first()
    assert (got.n, got.chars) == (4000, 8_000_000) and got.alive < 1500


def test_query_of_books_reads_from_bounded_batches(spark):
    from loomtext.plans import more

    plan = more.k5_books(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan
