"""Personal data by patterns and a semi-Markov conditional random field (operator 3).

The base patterns are exact and linear in the text. The model adds spans that they miss (telephone numbers without a plus,
addresses spelled with (at), numbers with other separators). It scores whole spans: digit group lengths, separators, check sum,
borders, the word before. A dynamic program over bounded spans chooses borders and types together; spans that overlap a base
span are not offered to it. Spans hold no letters but those of an e-mail address, so the text falls apart exactly into zones
between which nothing can be chosen, and only these are decoded.

It is trained here, by the gradient of the conditional likelihood, on TRAIN_LINES generated lines (bounded; a parameter).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_LINES, EPOCHS, SEED = 400, 6, 7
#: Bounds of a span that the model may choose: parts (runs of one character class), digits and characters; and for an address, the
#: characters and parts on each side of its (at). These are the entity bounds of the semi-Markov model; longer addresses with a
#: plain @ are found by the base pattern.
MOST_PARTS, LEAST_DIGITS, MOST_DIGITS, MOST_CHARS = 15, 7, 19, 64
SIDE_CHARS, LEFT_PARTS, RIGHT_PARTS = 64, 8, 9

#: Characters before a span in which a cue may stand; spans of a zone whose features are kept, or scored, at a time.
CUE_CHARS, SEEN = 16, 10_000

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CORE = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)
_MARK = re.compile(r"@|\x20?(?:\(at\)|\[at\])\x20?", re.I)
_NUMERIC = re.compile(r"[0-9\x20().+/-]+")
_PART = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_CUE = re.compile(r"([A-Za-z]{2,12})[:.\s#]{0,3}$")
#: Words that, before a span, say what it is.
CUES = frozenset("call tel phone fax mobile cell mail email contact write ip host server address card visa account payment order number id page version total year ref invoice".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end), leftmost and non-overlapping within a kind, in order of kind and start."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            s = at
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            m = _DOMAIN.match(text, at + 1) if s < at else None
            if m:
                out.append((0, s, m.end()))
                done = m.end()
            else:
                done = at + 1
            at = text.find("@", done)
    first = re.search("[0-9]", text)
    if not first:
        return out
    runs = [m.span() for m in _DIGITS.finditer(text, first.start())]
    i = 0
    while i + 3 < len(runs):
        quad = runs[i : i + 4]
        if all(text[a[1]] == "." and b[0] == a[1] + 1 for a, b in zip(quad, quad[1:])):
            if all(len(n) <= 3 and int(n or 0) <= 255 for n in (text[a:b].lstrip("0") for a, b in quad)):
                out.append((1, quad[0][0], quad[3][1]))
            i += 4
        else:
            i += 1
    for m in _CARD.finditer(text, first.start()):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _side(ch: str) -> str:
    return "none" if not ch else "a" if ch.isalpha() else "9" if ch.isdigit() else "space" if ch.isspace() else ch if ch in "\"'#.,;:=()-/@_" else "other"


def features(text: str, start: int, end: int) -> list[str]:
    """What a span is, as a whole: independent of the kind, which each weight adds."""
    span = text[start:end]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    rest = "".join(sorted(set(_DIGITS.sub("", span)) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    cue = _CUE.search(text, max(0, start - CUE_CHARS), start)
    quad = len(groups) == 4 and span == ".".join(groups)
    has_at = "@" in span or "(at)" in span.lower() or "[at]" in span.lower()
    out = [
        "bias",
        f"cue={cue[1].lower() if cue and cue[1].lower() in CUES else ''}",
        f"left={_side(text[start - 1 : start])}",
        f"right={_side(text[end : end + 1])}",
        f"at={has_at}",
        f"parts={'.' in span}{min(3, span.count(' '))}",
    ]
    if has_at:
        tail = re.split(r"@|\(at\)|\[at\]", span, flags=re.I)
        return out + [f"ats={len(tail)}", f"dots={min(3, tail[-1].count('.'))}", f"top={bool(re.search(r'[.][A-Za-z]{2,6}$', span))}", f"inner={bool(re.search(r'[^A-Za-z0-9._%+()@ -]', span))}", f"headgap={' ' in tail[0].strip()}", f"tailgap={' ' in tail[-1].strip()}"]
    return out + [f"digits={len(digits)}", "groups=" + "-".join(str(min(len(g), 9)) for g in groups[:7]), f"seps={rest}", f"luhn={13 <= len(digits) <= 19 and luhn(digits)}", f"quad={quad and all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"plus={span[0] == '+'}", f"paren={span[0] == '(' and ')' in span}"]


def zones(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int, bool]]]:
    """Candidate spans (start, end, is numeric), a list for each zone; no candidate overlaps a taken span or another zone."""
    found = []
    for m in _NUMERIC.finditer(text):
        run = m[0].rstrip("\x20().+/-")  # to the last digit
        if len(run) < LEAST_DIGITS:
            continue
        parts = [(p.start() + m.start(), p[0]) for p in _PART.finditer(run)]
        here = []
        for i, (at, p) in enumerate(parts):
            if not (p[0].isdigit() or p in "(+"):
                continue
            count = 0
            for j in range(i, min(len(parts), i + MOST_PARTS)):
                end = parts[j][0] + len(parts[j][1])
                if parts[j][1][0].isdigit():
                    count += len(parts[j][1])
                    if count > MOST_DIGITS or end - at > MOST_CHARS:
                        break
                    if count >= LEAST_DIGITS:
                        here.append((at, end, True))
        if here:
            found.append(here)
    marks = [m.span() for m in _MARK.finditer(text)]
    for before, (start, end), after in zip([(0, 0), *marks], marks, [*marks[1:], (len(text), 0)]):  # an address has one mark
        left = [x.start() for x in _PART.finditer(text, max(before[1], start - SIDE_CHARS), start)][-LEFT_PARTS:]
        right = [x.end() for x in _PART.finditer(text, end, min(after[0], end + SIDE_CHARS))][:RIGHT_PARTS]
        here = [(a, b, False) for a in left if text[a].isalnum() for b in right if text[b - 1].isalnum() and not re.search(r"\s{2}|\n", text[a:b])]
        if here:
            found.append(here)
    if taken:
        starts = sorted(taken)
        begin = [a for a, _ in starts]
        reach = list(accumulate((b for _, b in starts), max))  # spans of one kind do not overlap; kinds may
        found = [[c for c in z if (k := bisect_left(begin, c[1])) == 0 or reach[k - 1] <= c[0]] for z in found]
    found = sorted((z for z in found if z), key=lambda z: min(c[0] for c in z))
    joined: list[list[tuple[int, int, bool]]] = []
    reach = -1
    for z in found:
        if joined and min(c[0] for c in z) < reach:
            joined[-1].extend(z)
        else:
            joined.append(list(z))
        reach = max(reach, max(c[1] for c in z))
    return joined


class SemiCrf:
    """Linear scores of (kind, whole-span feature); text outside spans scores zero."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def rows(self, text: str, zone, grow: bool = False) -> list[list[int]]:
        if grow:
            return [[self.index.setdefault(n, len(self.index)) for n in features(text, a, b)] for a, b, _ in zone]
        out, seen = [], {}  # a span and what stands around it often come again in a zone
        for a, b, _ in zone:
            key = text[max(0, a - CUE_CHARS - 1) : a], text[a:b], text[b : b + 1]
            if key not in seen:
                if len(seen) == SEEN:
                    seen.clear()
                seen[key] = [self.index[n] for n in features(text, a, b) if n in self.index]
            out.append(seen[key])
        return out

    def scores(self, rows: list[list[int]], zone) -> np.ndarray:
        s = np.zeros((len(rows), len(KINDS)))
        if len(rows) == 1:
            s[0] = self.weights[rows[0]].sum(0)
        for i in range(0, len(rows) if len(rows) > 1 else 0, SEEN):
            part = rows[i : i + SEEN]
            np.add.at(s, np.repeat(np.arange(i, i + len(part)), [len(r) for r in part]), self.weights[[k for r in part for k in r]])
        numeric = np.array([n for _, _, n in zone], bool)
        s[numeric, 0] = -np.inf
        s[~numeric, 1:] = -np.inf
        return s

    @staticmethod
    def order(zone) -> tuple[np.ndarray, np.ndarray, int]:
        """Starts and ends as indices into the sorted border positions of the zone."""
        places = sorted({p for a, b, _ in zone for p in (a, b)})
        at = {p: i for i, p in enumerate(places)}
        return np.array([at[a] for a, _, _ in zone]), np.array([at[b] for _, b, _ in zone]), len(places)

    def decode(self, text: str, zone) -> list[tuple[int, int, int]]:
        """The best (kind, start, end)s, by dynamic programming over border positions."""
        s = self.scores(self.rows(text, zone), zone)
        kind, top = s.argmax(1), s.max(1)
        a, b, n = self.order(zone)
        by_end: list[list[int]] = [[] for _ in range(n)]
        for i, e in enumerate(b):
            by_end[e].append(i)
        best, back = [0.0] * n, [-1] * n
        for p in range(1, n):
            best[p] = best[p - 1]
            for i in by_end[p]:
                if best[a[i]] + top[i] > best[p] + 1e-12:
                    best[p], back[p] = best[a[i]] + float(top[i]), i
        out, p = [], n - 1
        while p > 0:
            if back[p] >= 0:
                i = back[p]
                out.append((int(kind[i]), zone[i][0], zone[i][1]))
                p = int(a[i])
            else:
                p -= 1
        return out[::-1]

    def learn(self, lines: list[tuple[str, list[tuple[int, int, int]]]], epochs: int, rate: float = 0.3, decay: float = 1e-3) -> None:
        data = []
        for text, gold in lines:
            for zone in zones(text, []):
                rows = self.rows(text, zone, grow=True)
                truth = {(g[1], g[2]): g[0] for g in gold}
                data.append((zone, rows, [truth.get((a, b), -1) for a, b, _ in zone], self.order(zone)))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        squares = np.full_like(self.weights, 1e-6)
        rng = random.Random(SEED)
        for _ in range(epochs):
            rng.shuffle(data)
            for zone, rows, truth, (a, b, n) in data:
                s = self.scores(rows, zone)
                flat = np.logaddexp.reduce(s, axis=1)
                fore, aft = np.full(n, 0.0), np.full(n, 0.0)
                by_end, by_start = [[] for _ in range(n)], [[] for _ in range(n)]
                for i in range(len(zone)):
                    by_end[b[i]].append(i), by_start[a[i]].append(i)
                for p in range(1, n):
                    fore[p] = np.logaddexp.reduce([fore[p - 1], *(fore[a[i]] + flat[i] for i in by_end[p])])
                for p in range(n - 2, -1, -1):
                    aft[p] = np.logaddexp.reduce([aft[p + 1], *(aft[b[i]] + flat[i] for i in by_start[p])])
                prob = np.exp(fore[a][:, None] + s + aft[b][:, None] - fore[n - 1])
                for i, t in enumerate(truth):
                    if t >= 0:
                        prob[i, t] -= 1
                for r, g in zip(rows, prob):
                    if np.abs(g).max() > 1e-4:
                        step = g + decay * self.weights[r]
                        squares[r] += step**2
                        self.weights[r] -= rate * step / np.sqrt(squares[r])


def generated(lines: int = TRAIN_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines of invented words with spans whose kind is known, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "le", "qu", "ei", "os", "ta", "in"]) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(ok: bool) -> str:
        body = rng.choice("3456") + num(14)
        last = next(d for d in "0123456789" if luhn(body + d) == ok)
        d = body + last
        sep = rng.choice(["", " ", "-", ".", ""])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if sep else d

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    def email() -> str:
        host = f"{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
        return word() + rng.choice(["", "." + word(), num(2)]) + rng.choice(["@", "@", " (at) ", " [at] ", "(at)", "[at]"]) + host

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    noise = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: num(rng.randint(7, 19)),
        lambda: f"{rng.randint(300, 999)}.{rng.randint(256, 999)}.{num(2)}.{num(3)}",
        lambda: card(False),
        lambda: " ".join(num(rng.randint(1, 5)) for _ in range(rng.randint(2, 6))),
        lambda: word() + " @ " + word(),
        lambda: "@" + word(),
        lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: f"{num(3)},{num(3)},{num(3)}",
        lambda: f"{num(4)}-{num(4)}",
    ]
    makers = {0: email, 1: ip, 2: lambda: card(True), 3: phone}
    cues = {0: ["mail", "contact", "write"], 1: ["ip", "host", "server"], 2: ["card", "visa", "payment"], 3: ["call", "tel", "phone"], -1: ["order", "page", "version", "ref"]}
    out = []
    for _ in range(lines):
        text, gold = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(word() for _ in range(rng.randint(1, 5)))
            kind = rng.choice([0, 1, 2, 3, 3, -1, -1, -1])
            text += " " + (rng.choice(cues[kind]) + rng.choice([" ", ": "]) if rng.random() < 0.4 else "")
            piece = makers[kind]() if kind >= 0 else rng.choice(noise)()
            if kind >= 0:
                gold.append((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", ", ", ". ", "### ", "; "])
        out.append((text + word(), gold))
    return out


@lru_cache(maxsize=1)
def trained(lines: int = TRAIN_LINES, epochs: int = EPOCHS) -> SemiCrf:
    model = SemiCrf()
    model.learn(generated(lines), epochs)
    return model


def find(text: str, model: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and the spans that the model adds, each (index of kind, start, end)."""
    if not _CORE.search(text):
        return [], []
    base = base_spans(text)
    added = [x for z in zones(text, [(a, b) for _, a, b in base]) for x in model.decode(text, z)]
    return base, sorted(added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detected(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans, a row for each row of docs.

    A null or empty text has no span. Very long texts are read whole; the time is linear in them. Positions are code points. Repeated
    rows and null doc_ids are kept; extra columns go; an empty table gives an empty result.
    """
    import pyarrow as pa

    model = model or trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, added = find(text, model)
                counts = [0] * len(KINDS)
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    bounded_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the earlier names the whole stretch."""
    out, done, name, start = [], 0, None, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if name is not None and a < done:
            done = max(done, b)
            continue
        if name is not None:
            out.append(f"[{name}]")
        out.append(text[done if name is not None else 0 : a])
        name, done = KINDS[k].upper(), b
    if name is None:
        return text
    return "".join(out) + f"[{name}]" + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of every text masked; n_chars, where there is one, follows. All rows and columns stay."""
    model = trained()

    @F.pandas_udf("string")
    def mask(texts):
        def one(t):
            if t is None:
                return None
            base, added = find(t, model)
            return masked_text(t, base + added) if base or added else t

        return texts.map(one)

    bounded_batches(docs.sparkSession)
    out = docs.withColumn("text", mask(docs["text"].cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))
