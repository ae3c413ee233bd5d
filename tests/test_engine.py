"""Operators of the engine: golden behaviour, properties, and every SQL oracle at the smallest scale."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions.unicode import slug_of
from loomtext.operators import align, checks, glossary, pages, plan, protocol, script
import loomtext.plans.lists  # noqa: F401
import loomtext.plans.more  # noqa: F401
import loomtext.plans.queries  # noqa: F401  registers the queries
import loomtext.plans.runs  # noqa: F401
from loomtext.plans.registry import ORACLE_SQL, QUERIES
from loomtext.sources import docx, epub, markdown, markup
from loomtext.streaming import leases

from .conftest import SMALL


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# alignment


def test_alignment_keeps_repeats_in_place():
    assert align.align(["Alpha", "Yes.", "Bravo", "Yes.", "Charlie"], ["Alpha", "Bravo", "Yes.", "Charlie"]) == [0, 2, 3, 4]
    old, new = ["a", "b", "c"], ["c", "a", "x", "b"]
    assert align.moved(old, new, align.align(old, new)) == [2, 0, None, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12), st.sampled_from([0, 10**6]))
def test_alignment_is_monotone_and_equal(old, new, cells):
    match = align.align(old, new, cells)
    pairs = [(m, j) for j, m in enumerate(match) if m is not None]
    assert all(old[m] == new[j] for m, j in pairs)
    assert [m for m, _ in pairs] == sorted({m for m, _ in pairs})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=12))
def test_rising_is_longest(xs):
    chain = align.rising(xs)
    assert all(xs[a] < xs[b] and a < b for a, b in zip(chain, chain[1:]))
    best = [1] * len(xs)
    for i in range(len(xs)):
        best[i] += max((best[j] for j in range(i) if xs[j] < xs[i]), default=0)
    assert len(chain) == max(best, default=0)


# text, markdown


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# H\n", "text\n", "\n", "```\n", "- i\n", "Chapter 1\n", "more\r\n", "~~~\n", "end"]), max_size=12), st.booleans())
def test_pieces_join_to_the_text(lines, md):
    text = "".join(lines)
    assert "".join(body + eol for _, body, eol in markdown.pieces(text, md)) == text


def test_markdown_blocks(spark):
    text = "# Book\n\nOne\ntwo\n\n## Part\n- item\n\n```\ncode\n\nmore\n```\n### Small\ntail"
    rows = markdown.read_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"), True).collect()
    assert [(r.sec_ord, r.block_id, r.kind, r.title) for r in rows] == [(1, "b1", "heading", "Book"), (1, "b2", "para", "Book"), (2, "b3", "heading", "Part"), (2, "b4", "item", "Part"), (2, "b5", "meta", "Part"), (2, "b6", "heading", "Part"), (2, "b7", "para", "Part")]
    assert markdown.write_in_place("﻿a\r\n\r\nb\r\n", False, {"b2": "x\ny"}) == "﻿a\r\n\r\nx\r\ny\r\n"


def test_split_block_parts_fit_and_join():
    text = " ".join(f"This is sentence number {i}, which says a thing." for i in range(60))
    parts = plan.split_block(text, 60)
    assert len(parts) > 1 and " ".join(parts) == text
    assert all(-(-len(p) // 4) <= 60 for p in parts)
    tagged = "<1>" + text + "</1>"
    assert plan.split_block(tagged, 60) == [tagged]


# checks and glossary


def test_tag_checks(spark):
    check = lambda a, b: value(spark, checks.tag_check(F.lit(a), F.lit(b)))
    assert check("<1>a</1> <2/>", "<2/> <1>b</1>").ok
    assert check("<1>a</1> <2/>", "<1>b</1>").missing == ["<2/>"]
    assert check("<1>a</1>", "<1>b</1><1>c</1>").extra == ["</1>", "<1>"]
    assert check("<1><2>a</2></1>", "<1><2>a</1></2>").misnested
    assert check("</1/>", "x").ok


@pytest.mark.parametrize("translation,target,found", [("Zvala se Petra.", "Petra", True), ("u jedini dan", "Edip", False), ("stoici su", "stoik", True), ("bez stoika", "stoici", True), ("velikom gradu", "veliki grad", True), ("x", "", True)])
def test_inflected_targets(spark, translation, target, found):
    assert value(spark, glossary.has_target(F.lit(translation), F.lit(target))) is found


def test_issues_of_one_place_merge_alike_in_any_order(spark):
    schema = "k long, ord long, type string, severity string"
    rows = [(k, o, t, s) for k in range(20) for o, t in ((1, "omission"), (2, "odd")) for s in ("minor", "major")]
    for order in (rows, rows[::-1]):
        got = checks.merge_reviews(spark.createDataFrame([], schema), spark.createDataFrame(order, schema).coalesce(1), ["k"]).collect()
        assert sorted((r.k, r.ord, r.type, r.severity) for r in got) == [(k, o, t, "major") for k in range(20) for o, t in ((1, "omission"), (2, "mistranslation"))]


def test_whole_word_terms(spark):
    g = spark.createDataFrame([(1, "Da", "x"), (2, "old  house", "y"), (3, "Mr.", "z"), (4, "é", "w")], "ord int, term string, target_term string")
    texts = spark.createDataFrame([(1, "A day at the Old\thouse with mr. Smith"), (2, "da, é!")], "id int, text string")
    got = {(r.id, r.ord) for r in glossary.relevant_entries(texts, ["id"], g).collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (2, 4)}


def test_glossary_table_round_trip(spark):
    rows = [(1, 1, "a|b", "c", "person", "f", None), (1, 2, "d", "e\nf", "term", None, "n")]
    e = spark.createDataFrame(rows, "k int, ord int, source string, target string, type string, gender string, note string")
    back = glossary.parse_table(glossary.table_text(e, ["k"]), ["k"]).orderBy("ord").collect()
    assert [(r.source, r.target, r.type, r.gender, r.note) for r in back] == [("a|b", "c", "person", "f", None), ("d", "e f", "term", None, "n")]


def test_replies(spark):
    parse = lambda r, ids: value(spark, protocol.parse_reply(F.lit(r), F.array(*map(F.lit, ids))))
    p = parse("<think>x</think>\n```xml\n<seg id='1'>a</seg>\n<seg id=2> </seg><seg id=\"1\">b</seg><seg id=\"9\">c</seg>\n```", ["1", "2", "3"])
    assert (p.segments, p.missing, p.extra, p.duplicate, p.conflicting, p.ok) == ({"1": "a"}, ["2", "3"], ["9"], ["1"], ["1"], False)
    assert parse('<seg id="1">a\nb</seg>', ["1"]).ok
    df = spark.range(1).select(protocol.parse_reply(F.lit('<seg id="1">a</seg><seg id="2">b</seg><seg id="3">c</seg>'), F.array(*map(F.lit, "1234"))).alias("p"))
    assert df.select(protocol.salvage(F.col("p"), F.array(*map(F.lit, "1234"))).alias("s")).first().s.ask == ["4"]


def test_scalar_functions(spark):
    assert value(spark, X.join_lines(F.lit("transla-"), F.lit("tion"))) == "translation"
    assert value(spark, X.join_lines(F.lit("a"), F.lit("B"))) == "a B"
    assert value(spark, X.text_outside_tags(F.lit("<1>NAME:</1> go <2/>now"))).split() == ["go", "now"]
    assert value(spark, X.first_json(F.lit('ok {"a": {"b": 1}} bye'))) == '{"a": {"b": 1}}'
    assert value(spark, X.speaker_name(F.lit("<1>PETRA (low):</1> Hi"))) == "PETRA"
    assert value(spark, X.same_hash(F.lit("SHA256:Ab"), F.lit("ab")))
    assert slug_of("Čudna  Knjiga!") == "cudna-knjiga" and slug_of("!!") == "book"


def test_script_parts_join(spark):
    lines = ["## A head ##", "PETRA (low):  Come in. ", "CLUE: box/key: a key", "  plain words  ", "FADE OUT", "* * *", ""]
    for line in lines:
        p = value(spark, script.line_parts(F.lit(line)))
        assert p.prefix + p.text + p.suffix == line
    assert value(spark, script.line_parts(F.lit(lines[1]))).text == "Come in."


# pages of positioned text


def test_paragraphs_of_positioned_lines(spark):
    rows = []
    for page in (1, 2):
        rows += [(1, page, 0, 780.0, 50.0, 200.0, 10.0, "The Running Head", True), (1, page, 9, 20.0, 50.0, 60.0, 10.0, f"- {page} -", True)]
    rows += [(1, 1, 1, 700.0, 50.0, 300.0, 16.0, "A Heading", False), (1, 1, 2, 670.0, 50.0, 500.0, 10.0, "This is a long line of transla-", False), (1, 1, 3, 658.0, 50.0, 500.0, 10.0, "tion that goes on without", False), (1, 2, 1, 700.0, 50.0, 300.0, 10.0, "an end.", False), (1, 2, 2, 670.0, 50.0, 500.0, 10.0, "New paragraph here.", False), (1, 2, 3, 658.0, 50.0, 500.0, 10.0, "And more.", False)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, ord int, y double, x double, x_end double, size double, text string, margin boolean")
    kept = pages.without_running_lines(lines).withColumn("ord", F.col("page") * 100 + F.col("ord"))
    got = pages.paragraphs(kept).orderBy("para").collect()
    assert [(r.heading, r.text) for r in got] == [(True, "A Heading"), (False, "This is a long line of translation that goes on without an end."), (False, "New paragraph here. And more.")]


def test_items_become_lines():
    items = [(700.0, 60.0, 30.0, 10.0, "world"), (701.0, 20.0, 30.0, 10.0, "Hello"), (650.0, 20.0, 10.0, 12.0, "x")]
    assert pages.group_lines(items) == [(701.0, 20.0, 90.0, 10.0, "Hello world"), (650.0, 20.0, 30.0, 12.0, "x")]


# books


def test_epub_round_trip():
    book = epub.build("My <Book>", [("One", [("heading", "One"), ("para", "Hello & bye.")]), ("Two", [("para", "Second.")])])
    assert book == epub.build("My <Book>", [("One", [("heading", "One"), ("para", "Hello & bye.")]), ("Two", [("para", "Second.")])])
    rows = {r["block_id"]: r for r in epub.read(book)}
    assert rows["d1.2"]["text"] == "Hello & bye." and rows["d1.1"]["kind"] == "heading" and rows["m.1"]["text"] == "My <Book>"
    out = {r["block_id"]: r["text"] for r in epub.read(epub.write(book, {"d1.2": "Zdravo.", "m.1": "Knjiga"}, "hr"))}
    assert out["d1.2"] == "Zdravo." and out["m.1"] == "Knjiga" and out["d2.1"] == "Second."
    assert zipfile.ZipFile(io.BytesIO(epub.write(book, {}))).namelist()[0] == "mimetype"


def test_inline_tags_and_writing_back():
    root = markup.parse_html("<body><div>loose <b>text</b><p>A <i>b <a href='x'>c</a></i> d<br>e</p><pre>no</pre></div></body>")
    found = markup.find_blocks(next(root.iter("body")))
    assert [(f.kind, f.text) for f in found] == [("para", "loose <1>text</1>"), ("para", "A <1>b <2>c</2></1> d<3/>e")]
    markup.apply(found[1], "<3/>X <1>y <2>z</2></1>")
    assert markup.find_blocks(next(root.iter("body")))[1].text == "<1/>X <2>y <3>z</3></2>"
    markup.apply(found[0], "broken <1>text")
    assert markup.find_blocks(next(root.iter("body")))[0].text == "broken text"


def test_blocks_of_any_depth():
    deep = "<b>" * 5000 + "x" + "</b>" * 5000
    found = markup.find_blocks(markup.parse_html("<div>" * 5000 + f"<p>one {deep}</p>two" + "</div>" * 5000))
    assert [f.text[:3] for f in found] == ["one", "two"] and len(found[0].elements) == 5000


def test_blocks_beside_scripts_and_within_inline():
    page = "<body><p>a<script>s</script>b</p><div>c<pre>no</pre>d<p>e</p></div><span>f<div>g</div></span><nav><ul><li>h</li></ul></nav><table><tr><td>i</td><th><!-- k -->j</th></tr></table></body>"
    root = markup.parse_html(page)
    found = markup.find_blocks(next(root.iter("body")))
    assert [(f.kind, f.text) for f in found] == [("para", "a<1/>b"), ("para", "c"), ("para", "d"), ("para", "e"), ("para", "<1>f<2>g</2></1>"), ("toc", "h"), ("cell", "i"), ("cell", "j")]


def test_chapters_that_are_not_strict_keep_their_numbers():
    book = epub.build("Book", [("One", [("para", "First.")]), ("Two", [("para", "Second.")])])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as z, zipfile.ZipFile(out, "w") as w:
        for i in z.infolist():
            data = z.read(i.filename)
            w.writestr(i, data.replace(b"First.", b"First&nbsp;one, <br>open.") if i.filename.endswith("c1.xhtml") else data)
    rows = {r["block_id"]: r["text"] for r in epub.read(out.getvalue())}
    assert rows["d1.1"].replace("\xa0", " ") == "First one, <1/>open." and rows["d2.1"] == "Second."
    again = {r["block_id"]: r["text"] for r in epub.read(epub.write(out.getvalue(), {"d1.1": "Prvo <1/>otvoreno."}))}
    assert again["d1.1"] == "Prvo <1/>otvoreno." and again["d2.1"] == "Second."


def _docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t, b="": f'<w:r><w:rPr>{b}</w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Title")}</w:p><w:p>{run("Some plain text and ")}{run("bold", "<w:b/>")}<w:r><w:tab/></w:r>{run(" end")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("other.bin", b"\x00\x01")
    return out.getvalue()


def _document(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_keeps_moved_text_fields_and_bookmarks():
    run = lambda t, b="": f'<w:r><w:rPr>{b}</w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'
    page = '<w:fldSimple w:instr=" PAGE "><w:r><w:t>7</w:t></w:r></w:fldSimple>'
    body = (
        f'<w:p><w:pPr><w:jc w:val="left"/></w:pPr>{run("one ")}<w:moveFrom>{run("away ")}</w:moveFrom><w:moveTo>{run("moved ")}</w:moveTo><w:customXml>{run("custom ")}</w:customXml>{run("end")}</w:p>'
        f'<w:p>{run("same ", "<w:lang w:val=&quot;en&quot;/>".replace("&quot;", chr(34)))}{run("words", "<w:noProof/>")}<w:r><w:lastRenderedPageBreak/><w:t> here</w:t></w:r></w:p>'
        f'<w:p>{run("a ")}<w:bookmarkStart w:id="1" w:name="x"/>{run("b ")}<w:bookmarkEnd w:id="1"/>{run("c ")}{page}</w:p>'
    )
    data = _document(body)
    assert [r["text"] for r in docx.read(data)] == ["one moved custom end", "same words here", "a b c <1/>"]
    out = docx.write(data, {"document-1": "jedan kraj", "document-3": "A B <1/> C"})
    assert [r["text"] for r in docx.read(out)] == ["jedan kraj", "same words here", "A B <1/> C"]
    xml = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert xml.index("bookmarkStart") < xml.index("A B") < xml.index(" PAGE ") < xml.index("> C<") < xml.index("bookmarkEnd")
    assert xml.index("w:jc" if "w:jc" in xml else ":jc") < xml.index("jedan kraj")


def test_docx_round_trip():
    data = _docx()
    rows = {r["block_id"]: r for r in docx.read(data)}
    assert [(r["kind"], r["text"]) for r in rows.values()][0] == ("heading", "Title")
    assert rows["document-3"]["kind"] == "cell"
    tagged = rows["document-2"]["text"]
    assert "<1>bold</1>" in tagged
    same = {r["block_id"]: r["text"] for r in docx.read(docx.write(data, {"document-2": tagged}))}
    assert same["document-2"] == tagged
    new = tagged.replace("Some plain text and", "Neki tekst i").replace("bold", "masno")
    assert {r["block_id"]: r["text"] for r in docx.read(docx.write(data, {"document-2": new}))}["document-2"] == new
    assert zipfile.ZipFile(io.BytesIO(docx.write(data, {}))).read("other.bin") == b"\x00\x01"


def test_books_as_tables(spark):
    files = spark.createDataFrame([("a.epub", bytearray(epub.build("T", [("One", [("para", "Hello.")])])))], "path string, content binary")
    rows = epub.read_blocks(files).collect()
    assert ("d1.1", "Hello.") in {(r.block_id, r.text) for r in rows}
    done = epub.write_files(files, spark.createDataFrame([("a.epub", "d1.1", "Bok.")], "path string, block_id string, text string"))
    assert "Bok." in {r.text for r in epub.read_blocks(done).collect()}


# state


def test_lease_replay():
    assert leases.replay([(0, "add", None), (1, "lease", 10), (5, "submit_bad", 10), (12, "submit_ok", None)]) == ("answered", 1, 15)
    assert leases.replay([(0, "add", None), (1, "lease", 10), (11, "submit_ok", None)])[0] == "waiting"
    assert leases.replay([(0, "add", None), (1, "lease", 10), (11, "lease", 10)]) == ("leased", 2, 21)
    assert leases.replay([(0, "add", None), (1, "cancel", None), (2, "lease", None)])[0] == "dropped"


def test_lease_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    ops = ["add", "lease", "submit_ok", "submit_bad", "release", "cancel", "lease"]
    rows = [(f"t{rng.randint(0, 9)}", i, "add" if i < 20 else rng.choice(ops), rng.choice([None, 5, 50])) for i in range(200)]
    schema = "task_id string, ms long, op string, lease_ms long"
    for k in range(2):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    want = {r.task_id: tuple(r) for r in leases.final_states(spark.createDataFrame(rows, schema)).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = leases.stream_states(stream).writeStream.outputMode("update").format("memory").queryName("lease_states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.task_id: tuple(r) for r in spark.sql("select * from lease_states").collect()}  # later rows of a task win
    assert got == want


# oracles


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import math

    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v)
        return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v if v is None else str(v)

    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLE_SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == sorted(df.columns)
    want = sorted(str([plain(r[at.index(c)]) for c in sorted(at)]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(at)]) for r in df.collect()) == want


# visual novels

SCRIPT = "---\ntitle: X\n---\n## A head\n\nPETRA (low): Come in.\nCLUE: box/key: a small key\nPlain words.\nFADE OUT.\n"


def test_scripts_round_trip():
    from loomtext.sources import novel

    assert novel.split_frontmatter("---\nopen") == ("", "---\nopen")
    rows = novel.read_script(SCRIPT)
    assert [(n, k, t) for n, k, t in rows] == [(0, "heading", "A head"), (2, "para", "<1>PETRA (low):</1> Come in."), (3, "para", "a small key"), (4, "para", "Plain words.")]
    assert novel.write_script(SCRIPT, {n: t for n, _, t in rows}) == SCRIPT
    out = novel.write_script(SCRIPT, {2: "<1>PETRA (low):</1> Udji.", 4: "IVAN: now a speaker"})
    assert "PETRA (low): Udji.\n" in out and "Plain words.\n" in out
    assert sorted(["ch-10.md", "ch-2.md"], key=novel.chapter_key) == ["ch-2.md", "ch-10.md"]
    assert novel.bible_names("# Characters\n- **Ana**: x\n# Places\n- **Hill**") == ["Ana"]
    assert novel.server_events('data: {"a":1}\n\ndata: b\ndata: c\r\n\r\ndata: [DONE]\n\ndata: d') == ['{"a":1}', "b\nc"]


def test_packs(spark):
    import json

    from loomtext.sources import novel

    pack = {"packHash": "h", "chapters": [{"n": 1, "scenes": [{"id": "s1", "placeKey": "p", "beats": [{"id": "b1", "type": "line", "speakerKey": "ANA"}, {"id": "b2", "type": "narration"}]}]}]}
    packs = spark.createDataFrame([("x", json.dumps(pack))], "pack_id string, json string")
    catalogs = spark.createDataFrame([("x", "en", json.dumps({"b1": "Hi.", "b2": "Rain."}))], "pack_id string, lang string, json string")
    rows = novel.pack_blocks(packs, catalogs).orderBy("ord").collect()
    assert [(r.beat, r.text) for r in rows] == [("b1", "<1>ANA:</1> Hi."), ("b2", "Rain.")]
    assert json.loads(novel.target_catalog(["b1", "b2"], {"b1": "Hi.", "b2": "Rain.", "z": "q"}, {"b1": "<1>ANA:</1> Bok."})) == {"b1": "Bok.", "b2": "Rain.", "z": "q"}


# structured answers


def test_structured_answers(spark):
    from loomtext.operators import replies

    issue = {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["a", "b", 1, None, True]}, "text": {"type": ["string", "null"], "minLength": 2}}}
    schema = {"type": "object", "required": ["score", "note"], "properties": {"score": {"type": "number"}, "n": {"type": "integer"}, "note": {"type": "string", "default": ""}, "ok": {"const": True}, "issues": {"type": "array", "minItems": 1, "items": issue}, "way": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "number"}}]}}}
    cases = {
        '<think>x</think>ok ```json\n{"score": 7, "issues": [{"kind": "a"}, {"kind": 1}, {"kind": null}, {"kind": true, "text": null}]}\n```': [],
        '{"score": 1.5, "n": 2, "ok": true, "way": [1, 2.5]}': [],
        '{"score": "7", "issues": []}': ["score: not number", "issues: too few items"],
        '{"score": 1, "n": 1.5, "ok": false, "way": ["x"]}': ["n: not integer", "ok: not True", "way: no allowed form"],
        '{"n": 3, "issues": [{"kind": "c", "text": "x"}, 4, {}]}': ["score: missing", "issues[0].kind: not one of ['a', 'b', 1, None, True]", "issues[0].text: too short", "issues[1]: not object", "issues[2].kind: missing"],
        "none": ["not a JSON object"],
        "[1]": ["not a JSON object"],
    }
    rows = spark.createDataFrame([(r,) for r in cases], "reply string")
    got = {r.reply: r.p for r in rows.select("reply", replies.structured("reply", schema).alias("p")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in cases.items()}


