"""Quality rules by weak supervision (operator 4).

Each rule votes good (1), bad (-1) or abstains (0) on a document. How accurate the rules are is not known and no label is read:
expectation-maximisation estimates, from how the votes of all documents fall together, the share of good documents and for each
rule and vote how likely it is among good and among bad ones. A document's verdict is the posterior probability of good. All
documents with the same votes have the same posterior, so the estimate works on counts of vote patterns, exact at any size and
at most 3 ** rules of them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, materialize, table, texts_of

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Measures of a text; the first five are the contract's.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_top_word", "n_lines", "n_stops", "n_digits", "n_bangs")
#: Rounds of expectation-maximisation, and the change of the log-likelihood a document at which it ends.
ROUNDS, SETTLED = 200, 1e-9
#: Prior weight, in documents' share, of the start; keeps a rule that never votes from dividing by zero.
SMOOTH = 1e-4


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that occur twice or more; the first occurrence counts too."""
    if len(words) <= window:
        return 0
    spans = list(zip(*(words[i:] for i in range(window))))
    if len(set(spans)) == len(spans):
        return 0
    often = Counter(spans)
    covered = last = 0
    for i, span in enumerate(spans):
        if often[span] > 1:
            covered += i + window - max(last, i)
            last = i + window
    return covered


def measures(text: str) -> tuple[int, ...]:
    """All of MEASURES for a whole text."""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    lines = 0
    for line in text.split("\n"):
        if line and line.encode().split():
            lines += 1
            dup += line in seen
            seen.add(line)
    common = Counter(words)
    joined = b"".join(words).decode()
    return (
        len(words),
        len(joined),
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        dup,
        repeated_words(words),
        len(common),
        sum(map(str.isupper, joined)) if not joined.islower() else 0,
        common.most_common(1)[0][1] if common else 0,
        lines,
        raw.count(b".") + raw.count(b"?"),
        sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))),
        raw.count(b"!"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES, a row for each row of docs; a null text has none of anything."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            cols = list(zip(*map(measures, b.column(1).to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *MEASURES])

    bounded_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def votes(c=F.col) -> dict[str, object]:
    """A column of -1, 0 or 1 for each rule, over MEASURES, each of which c() gives. Rules that look for a defect vote bad or abstain,
    as the lack of one defect says little; rules that look for prose vote good or abstain."""
    n = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    bad = lambda when: F.when(when, -1).otherwise(0)
    good = lambda when: F.when(when, 1).otherwise(0)
    head = F.least(n, F.lit(300))
    plain = (100 * c("n_symbols") <= 10 * n) & (100 * c("n_upper") <= 30 * chars) & (100 * c("n_digits") <= 15 * chars) & c("word_chars").between(3 * n, 12 * n)
    return {
        "length": bad(c("n_words") < MIN_WORDS),
        "word_length": bad(~c("word_chars").between(2 * n, 14 * n)),
        "symbols": bad(100 * c("n_symbols") > 25 * n),
        "dup_lines": bad((c("n_dup_lines") > 1) & (100 * c("n_dup_lines") > 30 * c("n_lines"))),
        "repeats": bad(100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "variety": bad((n >= 30) & ((100 * c("n_distinct") < 12 * head) | (100 * c("n_top_word") > 40 * n))),
        "capitals": bad((100 * c("n_upper") > 50 * chars) | (c("n_bangs") * 2 > n)),
        "digits": bad(100 * c("n_digits") > 30 * chars),
        "prose": good(plain & (c("n_stops") > 0) & (c("n_stops") * 60 >= n) & (c("n_bangs") * 10 <= n)),
        "fresh": good(plain & (100 * c("n_repeat_words") <= 10 * n) & (5 * c("n_dup_lines") <= c("n_lines"))),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents and p[class, rule, vote + 1], by expectation-maximisation over vote patterns.

    Starts from the belief that a vote is right four times in five, which also names the classes; a rule whose estimate turns
    against its own votes is held at no information, so classes cannot change names.
    """
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    weight = counts / counts.sum()
    total = patterns.sum(1)
    good = 1 / (1 + np.exp(-1.4 * total))
    seen = -np.inf
    share, p = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        share = float(np.clip((weight * good).sum(), SMOOTH, 1 - SMOOTH))
        for k, mass in enumerate((weight * (1 - good), weight * good)):
            p[k] = (np.einsum("n,nrv->rv", mass, onehot) + SMOOTH) / (mass.sum() + 3 * SMOOTH)
        against = p[1, :, 2] * p[0, :, 0] < p[0, :, 2] * p[1, :, 0]
        p[:, against] = p[:, against].mean(0)
        logs = np.stack([np.einsum("nrv,rv->n", onehot, np.log(p[k])) for k in (0, 1)]) + np.log([[1 - share], [share]])
        top = logs.max(0)
        level = top + np.log(np.exp(logs - top).sum(0))
        good = np.exp(logs[1] - level)
        now = float((weight * level).sum())
        if now - seen < SETTLED and seen > -np.inf:
            break
        seen = now
    return share, p


def posterior(patterns: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    logs = np.stack([np.einsum("nrv,rv->n", onehot, np.log(p[k])) for k in (0, 1)]) + np.log([[1 - share], [share]])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def vote_code(rule: dict) -> Column:
    """One number for the votes of all rules."""
    return sum(((v.cast("int") + 1) * 3**i for i, v in enumerate(rule.values())), F.lit(0)).cast("int")


def verdicts(rows: DataFrame, rule: dict) -> list[tuple[int, float]]:
    """(pattern, posterior of good) for each vote pattern of rows."""
    found = sorted(tuple(r) for r in rows.groupBy("pattern").agg(F.count("*")).collect())  # at most 3 ** rules
    if not found:
        return []
    codes = np.array([c for c, _ in found], np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rule))], 1)
    good = posterior(patterns, *estimate(patterns, np.array([n for _, n in found], float)))
    return [(int(c), float(g)) for c, g in zip(codes, good)]


def judged(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """doc_id, the contract's measures, base_failed, quality (posterior of good) and kept.

    A null, empty or white text has no words and fails. Very long texts are read whole, one at a time. Repeated rows count as
    often as they occur. Rows with a null doc_id keep it. Extra columns of docs are ignored; an empty table gives an empty result.
    """
    rule = votes()
    rows = materialize(measured(docs).select("doc_id", *MEASURES[:5], vote_code(rule).alias("pattern")), "votes")
    found = docs.sparkSession.createDataFrame(verdicts(rows, rule), "pattern int, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.join(F.broadcast(found), "pattern")
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= keep_from)).alias("kept"), "quality", "pattern")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def accepted(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """docs without the rows that the rules reject, as in judged(), each by its own text, null and repeated ids too; all columns stay.

    Texts are measured twice, once for the counts of vote patterns and once for the verdict, so that no row is moved or stored.
    """
    import pandas as pd

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measure(texts):
        return pd.DataFrame([measures(t or "") for t in texts], columns=MEASURES)

    bounded_batches(docs.sparkSession)
    name = free_name(docs, "measures")
    rows = docs.withColumn(name, measure(docs["text"].cast("string")))
    rule = votes(lambda m: F.col(f"`{name}`.{m}"))
    code = vote_code(rule)
    names = list(rule)
    fails = lambda c: any(c // 3 ** names.index(k) % 3 == 0 for k in ("length", "repeats"))  # noqa: E731  the contract's base rule
    good = [c for c, g in verdicts(rows.select(code.alias("pattern")), rule) if g >= keep_from and not fails(c)]
    return rows.where(code.isin(good)).select(*docs.columns)
