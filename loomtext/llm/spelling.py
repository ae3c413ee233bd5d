"""Spelling variants grouped without pairs (operator 13).

A word with one place blanked is the key of a group: all words of the group differ from one another in that place alone. The group
keeps its size and its two first words, so each member learns how many near words it has there and which is the commonest,
without meeting the others one by one. A word with one place left out meets the vocabulary: the word found is near, and learns in
turn how many longer words lead to it and which of them is the commonest. Added over its groups, that is all a word needs.

Keys are sums of numbers that stand for (place, code point), so all keys of a word are made in time linear in its length, long
unbroken ones included. A key has 128 bits; among 10^12 keys two different ones are equal with a chance under 10^-14.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table

#: The letters of a run: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word, and how much commoner its form must be.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a code point.
TYPO = 199
#: A member's key is of one of these: the word with a blank, with a place left out, and as it is.
BLANK, SHORT, WHOLE = 0, 1, 2


def runs_of(docs: DataFrame) -> DataFrame:
    """(word) of every run of at least MIN_LENGTH letters in every text, in lower case (A-Z only), with the planned typos."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))  # a shorter run makes no word
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    rows = rows.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    cut = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2))
    return rows.select(F.when(F.col("h") % TYPO == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, rank): the words, in `rank` order of falling n, then code points. The rank is unique, not gapless."""
    counted = runs_of(docs).groupBy("word").agg(F.count("*").alias("n"))
    words = counted.where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH))
    return words.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id())


def _stirred(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers of counting ones."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(codes: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Running sums, from 0, of the numbers of (place, code point); they wrap around."""
    each = _stirred(_stirred(places.astype(np.uint64) + np.uint64(salt)) ^ codes.astype(np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, kind, two halves of the key) of all keys of the words. Places left out that give the same word count once."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    place = at - starts[owner]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    of_blank = _stirred(place.astype(np.uint64) + np.uint64(1 << 62)) ^ _stirred(lengths[owner].astype(np.uint64) + np.uint64(1 << 63))
    halves = []
    for salt in (0, 1 << 60):
        here, moved = _sums(codes, place, salt), _sums(codes, place - 1 + (place == 0), salt)
        whole = here[starts[1:]] - here[starts[:-1]]
        blank = whole[owner] - (here[at + 1] - here[at]) + of_blank
        short = (here[at] - here[starts[owner]]) + (moved[starts[owner + 1]] - moved[at + 1])
        halves.append(np.concatenate([blank, short[first], whole]))
    index = np.concatenate([owner, owner[first], np.arange(len(words))])
    kind = np.repeat(np.array([BLANK, SHORT, WHOLE], np.int32), [len(codes), int(first.sum()), len(words)])
    return index, kind, halves[0].view(np.int64), halves[1].view(np.int64)


def _members(words: DataFrame) -> DataFrame:
    """(rank, kind, k1, k2): a row for each key of each word."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ranks = b.column(1).to_numpy()
            index, kind, k1, k2 = keys_of(b.column(0).to_pylist())
            for i in range(0, len(index), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (ranks[index], kind, k1, k2)], names=["rank", "kind", "k1", "k2"])

    bounded_batches(words.sparkSession)
    return words.select("word", "rank").mapInArrow(run, "rank long, kind int, k1 long, k2 long")


def _roots(links: DataFrame) -> DataFrame:
    """(rank, root): links (rank, form) followed to their ends, twice as far in each round; a form is commoner than its word, so there
    are no circles and as many rounds as the logarithm of the longest chain."""
    now = materialize(links.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ended = after.where("moved").isEmpty()
        discard(now)
        now = after
        if ended:
            return now.select("rank", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word, see the module.

    A null text has no words; a null doc_id counts as an empty one. A very long text is one row; a very long run is a word like any
    other. Ties of n go to the smaller word in code-point order. Repeated rows count as often as they occur. Extra columns are
    ignored. An empty table gives an empty result.
    """
    words = materialize(vocabulary(docs), "spelling-words")
    group = Window.partitionBy(F.when(F.col("kind") == BLANK, 0).otherwise(1), "k1", "k2")  # at most a member for each letter and place
    is_short = F.col("kind") == SHORT
    seen = _members(words).select(
        "rank",
        "kind",
        F.count("*").over(group).alias("size"),
        F.min("rank").over(group).alias("first"),
        F.nth_value("rank", 2).over(group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
        F.max(F.when(F.col("kind") == WHOLE, F.col("rank"))).over(group).alias("whole"),
        F.count(F.when(is_short, 1)).over(group).alias("n_longer"),
        F.min(F.when(is_short, F.col("rank"))).over(group).alias("longer"),
    )
    blank = F.col("kind") == BLANK
    told = seen.select(
        "rank",
        F.when(blank, F.col("size") - 1).when(is_short, F.col("whole").isNotNull().cast("long")).otherwise(F.col("n_longer")).alias("near"),
        F.when(blank, F.when(F.col("first") == F.col("rank"), F.col("second")).otherwise(F.col("first"))).when(is_short, F.col("whole")).otherwise(F.col("longer")).alias("best"),
    ).where("near > 0")
    near = told.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    full = words.join(near.join(best, "best"), "rank", "left")
    holds = F.col("form_n") >= RATIO * F.col("n")
    full = full.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(holds, F.col(c)).alias(c) for c in ("best", "form", "form_n")))
    full = materialize(full, "spelling-forms")
    roots = _roots(full.where("best is not null").select("rank", F.col("best").alias("form")))
    named = roots.join(words.select(F.col("rank").alias("root"), F.col("word").alias("last")), "root").select("rank", "last")
    return full.join(named, "rank", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same rows by joins of all near pairs. CRC-32 goes over the bytes, bit by bit.
SQL = rf"""with recursive r as (select coalesce(doc_id::varchar, '') as d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as run from documents),
 c as (select d, run, count(*) as k, hex(encode(d || ':' || run)) as x from r where length(run) >= {MIN_LENGTH} group by all),
 h as (select run, k, xor(4294967295, list_reduce(list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, (i + 1)::int, 2))::bigint), lambda s, b: list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), xor(s, b)), 4294967295)) as h from c),
 w as (select case when h % {TYPO} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n from h group by 1 having sum(k) >= {MIN_COUNT} and length(word) >= {MIN_LENGTH}),
 p as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
 blank as (select word, n, substr(word, 1, (i - 1)::int) || '*' || substr(word, (i + 1)::int) as k from p),
 short as (select distinct word, n, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as k from p),
 near as (select a.word, b.word as other, b.n as m from blank a join blank b on a.k = b.k and a.word <> b.word
  union all select s.word, w.word, w.n from short s join w on s.k = w.word union all select w.word, s.word, s.n from short s join w on s.k = w.word),
 best as (select word, count(*) as n_near, arg_max(other, (m, -row)) as other, max(m) as m from (select *, row_number() over (order by other) as row from near) group by word),
 f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * w.n then other end as form, case when m >= {RATIO} * w.n then m end as form_n from w left join best using (word)),
 t(word, last) as (select word, word from f union all select t.word, f.form from t join f on f.word = t.last where f.form is not null)
 select f.word, f.form, t.last as root, f.n, f.n_near, f.form_n from f join t using (word) join f e on e.word = t.last where e.form is null"""
