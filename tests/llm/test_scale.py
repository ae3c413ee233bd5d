"""What must not depend on size, order or luck: hot groups, cut models, hostile texts, and the whole pipeline by brute force."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import decontamination, html, packing, pii, ppm, quality, records, simhash
from loomtext.llm.common import table, tokenizer_path
from loomtext.llm.tokens import WordIds

from ..conftest import SMALL


def test_cut_suffixes_score_the_same(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    want = {r.doc_id: r.score for r in ppm.scored(docs).collect()}
    monkeypatch.setattr(ppm, "PIECE_GRAMS", 60)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 30_000)
    got = {r.doc_id: r.score for r in ppm.scored(docs).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_no_part_of_the_model_is_sent_twice(spark, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE_GRAMS", 60)
    stage = ppm.materialize(ppm._blocks(table(spark, SMALL, "documents"), 8), "t")
    cuts = ppm.pieces_by_suffix(stage)
    assert cuts
    counts = [r for r in ppm._gram_counts(ppm._cut(stage, cuts)).collect()]
    assert len({(r.key, r.piece) for r in counts}) == len(counts)
    grams = np.concatenate([np.frombuffer(r.a, np.uint64) for r in counts])
    assert len(np.unique(grams)) == len(grams)


def test_long_texts_score_as_by_a_plain_trie(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abeo") for _ in range(rng.randint(1, 4)))
    texts = {i: " ".join(word() for _ in range(n)) for i, n in enumerate((3000, 700, 0, 40, 1500, 900, 300))}
    order, end, trie = ppm.ORDER, bytes([ppm.END]), {}
    for d, t in texts.items():
        if not ppm.held_out(d):
            b = bytes([ppm.START]) * order + t.encode() + end
            for i in range(order, len(b)):
                for k in range(order + 1):
                    trie.setdefault(b[i - k : i], Counter())[b[i]] += 1
    for r in ppm.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        b, out = bytes([ppm.START]) * order + texts[r.doc_id].encode() + end, 0.0
        for i in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                rest = {s: n for s, n in trie.get(b[i - k : i], {}).items() if s not in gone}
                if not rest:
                    continue
                if b[i] in rest:
                    out += math.log10((2 * rest[b[i]] - 1) / (2 * sum(rest.values())))
                    break
                out += math.log10(len(rest) / (2 * sum(rest.values())))
                gone |= set(rest)
            else:
                out -= math.log10(ppm.ALPHABET - len(gone))
        assert r.score == pytest.approx(out, abs=2e-2)


@pytest.mark.parametrize("histogram", [{600: 40, 300: 40, 100: 7}, {1024: 3, 1000: 2, 24: 2}, {513: 5, 700: 9}, {1: 3000}, {5: 1}])
def test_the_program_is_solved_at_every_size(monkeypatch, histogram):
    calls = []
    solve = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda *a: calls.append(1) or solve(*a))
    chosen = packing.plan(histogram)
    got = Counter()
    for key, n in chosen:
        assert sum(length * m for length, m in key) <= 1024
        for length, m in key:
            got[length] += m * n
    assert calls and got == Counter(histogram)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_rounding_places_nine_in_ten(spark, size):
    pieces = packing.pieces_of(table(spark, f"/root/testdata/{size}", "documents"))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    chosen, by_rounding = packing.planned(histogram)
    short = sum(n for length, n in histogram.items() if length < 1024)
    assert by_rounding >= 0.9 * short
    lengths = np.array(sorted(histogram))
    plain = packing.best_fit(lengths, np.array([histogram[x] for x in lengths.tolist()]), 1024).total()
    assert sum(n for _, n in chosen) <= plain + 1 + plain // 1000


def test_the_program_beats_best_fit_where_that_fails():
    rng = np.random.default_rng(1)
    histogram = Counter((300 + rng.integers(0, 80, 4000)).tolist())  # three to a sequence, if the right three meet
    lengths = np.array(sorted(histogram))
    plain = packing.best_fit(lengths, np.array([histogram[x] for x in lengths.tolist()]), 1024).total()
    assert sum(n for _, n in packing.plan(histogram)) < 0.95 * plain


def test_many_pieces_of_a_length_take_no_time():
    began = time.time()
    assert sum(n for _, n in packing.plan({600: 10**9})) == 10**9
    assert time.time() - began < 5


def test_best_fit_by_counts_is_best_fit_one_by_one():
    rng = random.Random(3)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 200), 12)))
        demand = np.array([rng.randint(1, 30) for _ in lengths])
        room = []
        for length, n in sorted(zip(lengths.tolist(), demand.tolist()), reverse=True):
            for _ in range(n):
                fit = [x for x in room if x >= length]
                x = min(fit) if fit else 256
                if fit:
                    room.remove(x)
                room.append(x - length)
        got = packing.best_fit(lengths, demand, 256)
        assert sorted(256 - sum(lengths[k] * m for k, m in key) for key, n in got.items() for _ in range(n)) == sorted(room)


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_special_strings_are_the_library_s(name, byte_level):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path(name)), WordIds(tokenizer_path(name), byte_level)
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "word", "Word's", "é", "12", "  ", "<|", "|>", "日本", "...", "\t", "a<|endoftext|>b", "İ", "ﬁ", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode([text])[0], np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


HOSTILE_TEXTS = {"brackets": "(" * 1_000_000 + "1", "pluses": "+ " * 500_000 + "1", "plus ones": "+1(" * 330_000, "ats": "(at)" * 250_000, "at signs": "a@" * 500_000, "one address": "x@" + "b" * 1_000_000, "dots": "1." * 500_000}
HOSTILE_PAGES = {
    "open tags": "<a " * 340_000,
    "stray ends": "<div>" * 60_000 + "</b></q></p>" * 60_000,
    "items": "<div>" * 50_000 + "<li></li>" * 60_000,
    "far lists": "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 60_000,
    "inline": "<b>" * 100_000 + "<div></div>" * 60_000,
    "inline ends": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "quotes": '<b ">" ' * 150_000,
    "open quotes": "<a '" * 250_000 + ">",
    "comments": "<!--" * 250_000,
    "declarations": "<!" * 500_000,
}


@pytest.mark.parametrize("kind", HOSTILE_TEXTS)
def test_hostile_texts_take_linear_time(kind):
    model, text = pii.trained(), HOSTILE_TEXTS[kind]
    took = []
    for part in (text[: len(text) // 4], text[: len(text) // 2]):
        runs = []
        for _ in range(2):
            began = time.process_time()
            pii.find(part, model)
            runs.append(time.process_time() - began)
        took.append(min(runs))
    assert took[1] < 3 * took[0] + 0.2


@pytest.mark.parametrize("kind", HOSTILE_PAGES)
def test_hostile_pages_take_linear_time(kind):
    model, began = html.trained(), time.time()
    html.main_texts([HOSTILE_PAGES[kind]], model)
    assert time.time() - began < 30


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def stays(sets: dict) -> set:
    out = []
    for i in sorted(sets):
        if not any(alike(sets[i], sets[x]) for x in out):
            out.append(i)
    return set(out)


@pytest.mark.parametrize("small_run,rounds,bucket", [(16, 8, 1 << 18), (2, 8, 500), (2, 0, 1 << 18), (1, 1, 50)])
def test_hot_runs_do_not_change_what_stays(spark, monkeypatch, small_run, rounds, bucket):
    monkeypatch.setattr(simhash, "SMALL_RUN", small_run)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "BUCKET_POSTINGS", bucket)
    rng = random.Random(31)
    word = lambda: f"w{rng.randint(0, 900)}"
    rows, ids = [], rng.sample(range(1000), 160)
    for g in range(4):  # groups whose members drift apart, so that some pairs are similar and some are not
        base = [word() for _ in range(120)]
        for _ in range(40):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word()
            rows.append((ids.pop(), " ".join(base + [word() for _ in range(rng.randint(0, 10))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    assert set(sets) - {r._id for r in simhash.near_copies(docs).collect()} == stays(sets)


# the pipeline by brute force


def brute_tiles(item: list[str], text: list[str], least: int) -> int:
    """Words of item under greedy tiles, by looking for the longest common run again and again."""
    p, t = [False] * len(item), [False] * len(text)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not p[i + k] and not t[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        p[i : i + k] = t[j : j + k] = [True] * k
        covered += k


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    # near copies: components at four bits, then what is similar to a smaller one that stays
    fps = dict(zip(kept, simhash.fingerprint_array([texts[d] for d in kept]).tolist()))
    first = {}
    for d in sorted(kept):
        near = {first[x] for x in first if (fps[x] ^ fps[d]).bit_count() <= 4}
        low = min(near | {d})
        first = {x: low if f in near else f for x, f in first.items()} | {d: low}
    left = stays({d: simhash.shingle_set(texts[d]) for d in set(first.values())})
    items = [decontamination.words(r.text) for r in table(spark, SMALL, "benchmark").collect() if r.text]
    clean = set()
    for d in left:
        w = decontamination.words(texts[d])
        grams = {tuple(w[i : i + 5]) for i in range(len(w))}
        hit = False
        for item in items:
            least = min(5, len(item))
            if item and any(tuple(item[i : i + 5]) in grams for i in range(len(item) - least + 1)):
                hit |= brute_tiles(item, w, least) >= 0.5 * len(item)
        if not hit:
            clean.add(d)
    model, tokenizer = pii.trained(), Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    want = set()
    for d in clean:
        base, added = pii.find(texts[d], model)
        ids = [*tokenizer.encode(pii.masked_text(texts[d], base + added), add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.add((d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_an_id_of_many_rows_is_many_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)], "doc_id long, text string")
    manifest = records.written(docs, f"file://{tmp_path}/r", per_file=50)
    assert manifest.count() >= 4 and sum(r.n_docs for r in manifest.collect()) == 400
    at = 0
    for r in sorted(records.read_back(manifest).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_the_memory_of_words_is_bounded(monkeypatch):
    from loomtext.llm import tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 10)
    own, free = (WordIds(tokenizer_path("word_bpe_49k.json"), False) for _ in range(2))
    texts = [" ".join(f"word{i} w{'x' * (i % 90)}" for i in range(200)), "base64" * 50_000, "a b c " * 50]
    got = own.encode(texts)
    assert len(own.seen) <= 10 and max(map(len, own.seen)) <= 64
    monkeypatch.setattr(tokens, "MOST_WORDS", 10**9)
    assert got == free.encode(texts) == free.whole(texts)


def test_estimation_over_patterns_is_estimation_row_by_row():
    """The posterior of every row from expectation-maximisation over single rows, written out, is that of its vote pattern; and it
    outvotes a careless rule that all-must-pass would obey, on the side of what the rows are."""
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.7
    accuracy = [0.95, 0.92, 0.9, 0.62, 0.9]  # the fourth rule is careless
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where((rng.random(4000) < a) == truth, 1, -1)) for a in accuracy], 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, p = quality.estimate(patterns, counts.astype(float))
    got = quality.posterior(patterns, share, p)[where.ravel()]

    good = 1 / (1 + np.exp(-1.4 * votes.sum(1)))
    before = -np.inf
    for _ in range(quality.ROUNDS):
        prior = min(max(good.mean(), quality.SMOOTH), 1 - quality.SMOOTH)
        odds = {}
        for k, belief in ((0, 1 - good), (1, good)):
            mass = belief.sum() / len(votes)
            odds[k] = [[(belief[votes[:, r] == v].sum() / len(votes) + quality.SMOOTH) / (mass + 3 * quality.SMOOTH) for v in (-1, 0, 1)] for r in range(5)]
        logs = [np.log(w) + sum(np.log(np.array(odds[k][r])[votes[:, r] + 1]) for r in range(5)) for k, w in ((0, 1 - prior), (1, prior))]
        good = 1 / (1 + np.exp(logs[0] - logs[1]))
        now = float(np.logaddexp(*logs).mean())
        if now - before < quality.SETTLED:
            break
        before = now
    assert np.abs(good - got).max() < 1e-6
    kept, all_pass = got >= 0.5, (votes >= 0).all(1)
    assert (kept == truth).mean() > 0.95 and (all_pass == truth).mean() < 0.75 and (kept & ~all_pass & truth).sum() > 500
