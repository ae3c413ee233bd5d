"""Operators against brute force, exact round trips or held-out accuracy, on small inputs."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import chat, decontamination, html, packing, pii, ppm, quality, records, sharding, simhash, tokens
from loomtext.llm.common import new_path, table, tokenizer_path
from loomtext.llm.queries import QUERIES

from ..conftest import SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# 1: prediction by partial matching


def test_ppm_against_a_plain_trie(spark, texts):
    order, end = ppm.ORDER, bytes([ppm.END])
    lower = {d: t.encode().lower() for d, t in texts.items()}
    trie, words = {}, Counter()
    for d, t in lower.items():
        if ppm.held_out(d):
            continue
        words.update(t.split()), words.update([None])
        b = bytes([ppm.START]) * order + t + end
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def score(t):
        b, out = bytes([ppm.START]) * order + t + end, 0.0
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
        return out

    n, v = sum(words.values()), len(words)
    got = ppm.scored(table(spark, SMALL, "documents")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [*lower[r.doc_id].split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(words[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w))
        if len(w) < 150:
            assert r.score == pytest.approx(score(lower[r.doc_id]), abs=1e-3)


# 2: sharding


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 400) for _ in range(200)]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(x, k) for k, x in enumerate(room) if x >= sizes[i]]
            k = min(fit)[1] if fit else len(room)
            if not fit:
                room.append(1000)
            room[k] -= sizes[i]
            want[i] = k
        assert sharding.best_fit_decreasing(sizes, 1000) == want


def test_shards(spark, texts):
    got = sharding.sharded(table(spark, SMALL, "documents")).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(texts))
    shards, where = {}, {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert sorted(shards) == list(range(8))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    sums = [sum(r.size for r in own) for own in shards.values()]
    assert max(sums) <= 1.01 * min(sums)


# 3: personal data


def plain_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_plain_patterns(texts):
    rng = random.Random(5)
    made = ["".join(rng.choice("0123456789a@.+- ()%") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in [*texts.values(), *made]:
        assert pii.base_spans(t) == plain_base(t)


def test_semi_crf_decodes_the_best_labelling_and_generalises():
    model = pii.trained()
    hit = extra = missed = 0
    for text, gold in pii.generated(200, seed=99):
        got = {x for z in pii.zones(text, []) for x in model.decode(text, z)}
        hit, extra, missed = hit + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95
    text = "tel 555-123-4567 12 mail a (at) b.com"
    for zone in pii.zones(text, []):
        zone = zone[:12]
        s = model.scores(model.rows(text, zone), zone).max(1)
        best = 0.0
        for pick in range(1 << len(zone)):
            chosen = sorted(zone[i] for i in range(len(zone)) if pick >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(s[i] for i in range(len(zone)) if pick >> i & 1))
        found = model.decode(text, zone)
        value = sum(s[[z[:2] for z in zone].index((a, b))] for _, a, b in found)
        assert value == pytest.approx(best)


def test_masking():
    assert pii.masked_text("a b@c.de +1 (555) 123 4567 z", [(0, 2, 8), (3, 9, 26)]) == "a [EMAIL] [PHONE] z"
    assert pii.masked_text("12345", [(2, 0, 4), (3, 2, 5)]) == "[CARD]"


# 4: quality rules


def test_measures_against_plain_counts(texts):
    for t in texts.values():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often, covered = Counter(spans), set()
        for i, s in enumerate(spans):
            if often[s] > 1:
                covered.update(range(i, i + 5))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert quality.measures(t)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    right = np.array([0.9, 0.8, 0.85, 0.6])
    speaks = rng.random((20000, 4)) < 0.7
    votes = np.where(speaks, np.where(rng.random((20000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None], 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, p = quality.estimate(patterns, counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.03)
    assert np.allclose(p[1, :, 2] / (p[1, :, 2] + p[1, :, 0]), right, atol=0.04)


def test_verdicts_agree_with_labels(spark):
    got = {r.doc_id: r for r in quality.judged(table(spark, SMALL, "documents")).collect()}
    labels = [(got[r.doc_id], r.quality) for r in table(spark, SMALL, "labels").collect()]
    fair = [(g, q) for g, q in labels if not g.base_failed]
    assert sum(g.kept == bool(q) for g, q in fair) >= 0.95 * len(fair)
    assert not any(r.kept for r in got.values() if r.base_failed)


# 5: decontamination


def test_tiles_against_plain_greedy():
    def plain(p, t, least):
        a, b, out = [0] * len(p), [w == 0 for w in t], 0
        while True:
            best = (0, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not a[i + k] and not b[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            k, i, j = best
            if k < least:
                return out
            for z in range(k):
                a[i + z] = b[j + z] = 1
            out += k

    rng = random.Random(3)
    for _ in range(800):
        p = [rng.randint(1, 4) for _ in range(rng.randint(1, 20))]
        t = [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        least = rng.randint(1, 4)
        assert sum(k for k, _, _ in decontamination.tiles(p, t, least)) == plain(p, t, least)


def test_leaks_found_also_in_other_order(spark):
    bench = table(spark, SMALL, "benchmark")
    item = bench.orderBy("item_id").first()
    w = item.text.split()
    half = len(w) // 2
    docs = spark.createDataFrame([(1, "so it goes " + item.text + " and on"), (2, " ".join(w[half:] + ["then"] + w[:half])), (3, "nothing of it here " * 30), (4, " ".join(w[: len(w) // 3]))], "doc_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, item.item_id), (2, item.item_id)}
    assert {r.doc_id for r in decontamination.cleaned(docs, bench).collect()} == {3, 4}


def test_decontamination_in_parts_gives_the_same(spark, monkeypatch):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "PART_BYTES", 4000)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == want


# 6: main text


def test_main_text_of_unseen_pages():
    rng = random.Random(17)
    pages = [html.generated(rng).replace("‡", "‡ ") for _ in range(60)]
    wrong = total = 0
    for page, got in zip(pages, html.main_texts(pages, html.trained())):
        want = [n.text for n in html.node_features(html.parse(page))[0] if n.text.startswith("‡")]
        lines = got.split("\n") if got else []
        total += len(want)
        wrong += len(set(want) ^ set(lines))
    assert wrong <= 0.02 * total


def test_labels_are_hierarchical_and_likeliest():
    nodes, _ = html.node_features(html.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>"))
    rng = np.random.default_rng(4)
    for _ in range(50):
        odds = rng.normal(0, 2, len(nodes))
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = max(
            (sum(yes[i] if pick >> i & 1 else no[i] for i in range(len(nodes))), pick)
            for pick in range(1 << len(nodes))
            if all(n.parent is None or not pick >> i & 1 or pick >> n.parent.spot & 1 for i, n in enumerate(nodes))
        )
        assert sum(1 << i for i, k in enumerate(html.decode(nodes, odds)) if k) == best[1]


def test_parse_of_broken_markup():
    leaves = lambda p: [n.text for n in html.node_features(html.parse(p))[0] if n.tag == "#text"]
    assert leaves("<p><b>one<br><p>two &amp; <i>three</i></p>four<script>var t='</p>';</script><!-- x <p> -->five") == ["one", "two & three", "fourfive"]
    assert leaves("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]


# 7: packing


def test_pieces_and_sequences(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    got = packing.packed(table(spark, SMALL, "documents")).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    for d, x in texts.items():
        ids, at = [*t.encode(x, add_special_tokens=False).ids, 2], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            r = pieces.pop((d, k))
            assert (r.start, r.length, r.ids_crc32) == (at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])))
            at += n
    assert not pieces
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.05 * sum(r.length for r in got) / 1024 + 1


def test_plan_holds_every_length_and_beats_a_plain_pass():
    rng = np.random.default_rng(0)
    histogram = Counter(np.minimum(1024, rng.lognormal(6, 0.8, 20000).astype(int) + 1).tolist())
    got, sequences = Counter(), 0
    for key, n in packing.plan(histogram):
        assert sum(length * m for length, m in key) <= 1024
        sequences += n
        for length, m in key:
            got[length] += m * n
    assert got == histogram
    assert sequences <= 1.003 * sum(k * v for k, v in histogram.items()) / 1024


# 8: chat


def test_chat_round_trip():
    path, rng = tokenizer_path(chat.TOKENIZER), random.Random(2)
    bits = ["\\", "<|", "</turn>", "<|turn|>", "<|text|>", "<|endoftext|>", "###", " ", "\n", "a", "é", "中", "😀", "|>", "<", "#", "assistant", "  "]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "<|x"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]
        ids, mask, _ = chat.formatted(turns, path)
        assert chat.read_turns(ids, path) == turns
        assert chat.read_loss(ids, mask, path) == [t for r, t in turns if r == "assistant" and t]


def test_conversations_read_back(spark, monkeypatch):
    own: dict = {-7: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in table(spark, SMALL, "conversations").orderBy("conv_id", "turn").collect():
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = chat.op8_chat_formatting(spark, SMALL).collect()
    assert len(got) == len(own)
    for r in got:
        turns = own[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# 9: records


def test_records_round_trip(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(records.TOKENIZER))
    manifest = records.written(table(spark, SMALL, "documents"), new_path(spark, "t"), per_file=40)
    got = {r.doc_id: r for r in records.read_back(manifest).collect()}
    at = 0
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    first = min(manifest.collect())
    doc_id, ids = records.read_record(first.path, 3)
    assert doc_id == sorted(texts)[3] and len(ids) == got[doc_id].n_tokens


def test_records_of_a_range_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_RANGES", 2)
    docs = table(spark, SMALL, "documents")
    manifest = records.written(docs, new_path(spark, "t"), per_file=10)
    assert manifest.count() > 4 and max(r.n_docs for r in manifest.collect()) <= 20
    at = 0
    for r in sorted(records.read_back(manifest).collect()):
        assert r.start == at
        at += r.n_tokens


def test_damage_is_seen():
    import io

    good = records.frame(records.payload_of(1, b"\x01\x00", 2))
    assert [records.parsed(p)[0] for p in records.read_frames(io.BytesIO(good + good))] == [1, 1]
    for i in range(len(good)):
        bad = good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]
        with pytest.raises(ValueError):
            list(records.read_frames(io.BytesIO(bad)))


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_ids_equal_the_whole_tokenizer(name, byte_level, texts):
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \n\t'aZéß9.,!s²½İ́中 \x1c\x85$_tre—…😀") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    e = tokens.WordIds(tokenizer_path(name), byte_level)
    own = [*texts.values(), *odd]
    assert e.encode(own) == e.whole(own)


# 10: near duplicates


def test_trie_links_against_all_pairs():
    rng = np.random.default_rng(7)
    for n, flips in ((60, 3), (200, 6), (40, 2)):
        base = rng.integers(0, 2**63, 6, dtype=np.uint64)
        vals = np.unique(np.array([int(base[rng.integers(6)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, flips))) for _ in range(n)], np.uint64))
        keys = rng.integers(0, 2, len(vals))
        a, b = simhash.trie_links(keys, vals, 4)
        label = simhash._settle(len(vals), np.maximum(a, b), np.minimum(a, b), np.arange(len(vals)))
        want = np.arange(len(vals))
        for i in range(len(vals)):
            for j in range(i):
                if keys[i] == keys[j] and (int(vals[i]) ^ int(vals[j])).bit_count() <= 4:
                    want[want == want[i]] = want[j]
        same = lambda x: [[x[i] == x[j] for j in range(len(x))] for i in range(len(x))]
        assert same(label) == same(want)


def test_near_duplicates_against_all_pairs(spark, texts):
    import xxhash

    def fp(t):
        w = t.encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d: fp(t) for d, t in texts.items()}
    comp = {d: d for d in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 4 and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    got = simhash.near_duplicates(table(spark, SMALL, "documents")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", comp[d]) for d in fps}


def test_similar_documents_go_and_others_stay(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[100] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, t), (300 + i, " ".join(w[:60] + [f"n{k}" for k in range(140)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert kept == {*range(20), *range(300, 320)}
    # in parts first: the same documents go
    gone = {r._id for r in simhash.near_copies(docs, part=10).collect()}
    assert gone == {*range(100, 120), *range(200, 220)}


def test_no_similar_pair_is_missed(spark):
    rng = random.Random(19)
    rows = []
    for i in range(60):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((40, 150, 600)))]
        rows.append((i, " ".join(w)))
        rows.append((100 + i, " ".join(w + [f"n{rng.randint(0, 3000)}" for _ in range(len(w) * 18 // 100)])))
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    assert all(len(sets[i] & sets[100 + i]) >= 0.8 * len(sets[i] | sets[100 + i]) for i in range(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id for r in simhash.near_copies(docs).collect()} == {*range(100, 160)}


def test_survivors_do_not_depend_on_parts(spark, monkeypatch):
    rng = random.Random(23)
    rows = []
    for i in range(40):  # steps of a chain are similar, every other one is not
        w = [f"w{rng.randint(0, 3000)}" for _ in range(480)]
        rows += [(1000 * i + x, " ".join(w[30 * k : 30 * k + 300])) for k, x in enumerate(rng.sample(range(100), 7))]
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = []
    for i in sorted(sets):
        if not any(alike(i, x) for x in stay if x // 1000 == i // 1000):
            stay.append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part, rounds in ((2, 6), (1_000_000, 0)):
        monkeypatch.setattr(simhash, "ROUNDS", rounds, raising=False)
        assert set(sets) - {r._id for r in simhash.near_copies(docs, part=part).collect()} == set(stay)


def test_components_of_long_chains(spark):
    from loomtext.llm.components import components

    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r.u: r.v for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    final = {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {d for d, _ in final} == {r.doc_id for r in docs.collect()}
