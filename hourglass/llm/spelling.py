"""Operator 12: spelling variants by blocked Gram matrices of letter counts.

Words are letter runs, counted over all documents; two are *near* if they differ by
exactly one inserted, deleted or replaced code point.  A word's *form* is its near
word of largest count if that is at least RATIO times its own; following forms
gives its *root*.

How near words are found: of two words that differ in one place, either the first
or the last halves are equal (halves of the shorter one's length).  So
words are dealt to blocks by length, or by two adjacent lengths, and a half.  In a block
the rows' letter counts X give all squared distances by one matrix product,
|x|^2 + |y|^2 - 2 X X'.  A replacement has distance 2, an insertion 1; only such pairs are
held against each other letter by letter, and a pair is taken in one block.  A block of
over BLOCK words is split in parts, and each pair of parts is a task's tile.  From a
tile come, per word, the number of near words and the best one, not the pairs.

Null and empty texts: no words.  A null id counts as the empty text in the hash that
picks the runs to change.  Repeated rows count again, and are changed alike.  Long words
go through the same steps.  Empty table: no words.  Other columns aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DROP_EVERY = 199           # of the hash of an id and a run: such runs lose a letter
BLOCK = 2048               # words of one block (or part) in a tile
TILE = 192                 # rows of small blocks that share a product
HELD_WORDS = 400_000       # counts held in a task before they are passed on
_RUN = re.compile("[a-zÀ-ÿ]+")


def changed(doc_id, run: str, every: int | None) -> str:
    """``run`` of a document without one code point, if the hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if every and h % every == 0 else run


def _count(every: int | None):
    """(id as text, text) -> (word, n), summed within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out
        for b in batches:
            ids = b.column(0).to_pylist()
            d, o = text.utf8(b.column(1))
            for k, doc_id in enumerate(ids):
                found = Counter(_RUN.findall(text.LOWER[d[o[k]:o[k + 1]]].tobytes().decode()))
                if every:
                    base = zlib.crc32(f"{doc_id or ''}:".encode())
                    for w in [w for w in found if zlib.crc32(w.encode(), base) % every == 0]:
                        n = found.pop(w)
                        found_as = changed(doc_id, w, every)
                        if found_as:
                            total[found_as] += n
                total.update(found)
                if len(total) > HELD_WORDS:
                    yield flush()
        if total:
            yield flush()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = DROP_EVERY) -> DataFrame:
    """(word, n) of all letter runs."""
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_count(every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells them apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)                                  # first difference, by halving
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[lo + (len(a) == len(b)):] == b[lo + 1:]


def letter_counts(words: list[str]) -> np.ndarray:
    """A row a word: how often each letter stands in it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    _, letter = np.unique(codes, return_inverse=True)
    wide = int(letter.max(initial=-1)) + 1
    return np.bincount(row * wide + letter, minlength=len(words) * wide).reshape(len(words), wide).astype(np.float64)


def close_pairs(x: np.ndarray, block: np.ndarray, part: np.ndarray, split: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows of one block whose squared distance is the block's ``apart``
    (1 or 2); of a ``split`` block only those of different parts."""
    q = (x * x).sum(axis=1)
    d = q[:, None] + q[None, :] - 2.0 * (x @ x.T)
    near = (d == apart[:, None]) & (block[:, None] == block[None, :])
    if split.any():
        near &= ~split[:, None] | (part[:, None] != part[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    return i, j


NEAR = "word string, n_near bigint, best_n bigint, best string"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pair of parts p <= q, part, word, n) sorted by (block, p, q) -> NEAR."""
    def solve(t: pa.Table) -> pa.RecordBatch | None:
        names, part, words, n = (t.column(k).to_pylist() for k in (0, 3, 4, 5))
        cell = t.column(0).combine_chunks().dictionary_encode().indices.to_numpy() * 1.0
        p, q = t.column(1).to_numpy(), t.column(2).to_numpy()
        new = np.append(True, (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        block = np.cumsum(new) - 1
        begin = np.append(np.flatnonzero(new), len(new))
        apart = np.array([2 if s[0] == "=" else 1 for s in names])
        part, split = np.array(part), p != q
        count, best = Counter(), {}

        def take(a: int, b: int) -> None:
            for u, v in ((a, b), (b, a)):
                w = words[u]
                count[w] += 1
                key = (-n[v], words[v])
                if w not in best or key < best[w]:
                    best[w] = key
        k = 0
        while k < len(begin) - 1:
            e = k + 1                                           # blocks k..e-1 share a product
            while e < len(begin) - 1 and begin[e + 1] - begin[k] <= TILE:
                e += 1
            rows = slice(int(begin[k]), int(begin[e]))
            i, j = close_pairs(letter_counts(words[rows]), block[rows], part[rows], split[rows], apart[rows])
            for a, b in zip((i + rows.start).tolist(), (j + rows.start).tolist()):
                if one_edit(words[a], words[b]):
                    half = min(len(words[a]), len(words[b])) // 2
                    if names[a][1] == "<" or words[a][:half] != words[b][:half]:
                        take(a, b)
            k = e
        if not count:
            return None
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()),
                                           pa.array([-best[w][0] for w in count], pa.int64()), pa.array([best[w][1] for w in count], pa.string())],
                                          ["word", "n_near", "best_n", "best"])

    held, rows, enough = [], 0, 8 * BLOCK
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t.column(k)[-1].as_py() for k in range(3)]
            same = pa.compute.equal(t.column(0), last[0])
            for k in (1, 2):
                same = pa.compute.and_(same, pa.compute.equal(t.column(k), last[k]))
            cut = rows - pa.compute.sum(same).as_py()           # the last cell may go on
            if cut and (out := solve(t.slice(0, cut))) is not None:
                yield out
            held, rows = t.slice(cut).to_batches(), rows - cut
            enough = max(8 * BLOCK, 2 * rows)
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def cells(words: DataFrame) -> DataFrame:
    """Every word in each of its blocks: (block, p, q, part, word, n).  A block's name says whether
    lengths are equal (=) or adjacent (+), which half is shared (< first, > last), and that half."""
    n = F.char_length("word")

    def halves(kind: str, short):
        half = F.floor(short / 2).cast("int")
        tag = F.concat(F.lit(kind), short.cast("string"), F.lit(":"))
        return [F.concat(F.lit(f"{kind}<"), tag, F.substring(F.col("word"), F.lit(1), half)),
                F.concat(F.lit(f"{kind}>"), tag, F.substring(F.col("word"), (n - (short - half) + 1).cast("int"), (short - half).cast("int")))]
    named = words.select("word", "n", F.explode(F.array(*halves("=", n), *halves("+", n), *halves("+", n - 1))).alias("block"))
    size = named.groupBy("block").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = named.join(size, "block").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of every word that has near words, how many, and the one of
    largest count (ties: the smallest)."""
    dealt = cells(words).repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")
    found = dealt.mapInArrow(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(linked: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of (word, form): pointers are doubled ``rounds`` times."""
    now = linked.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = common.save(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int | None = DROP_EVERY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``least_length`` letters that
    occurs at least ``least_count`` times."""
    words = word_counts(docs, id_col, text_col, every)
    words = common.save(words.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    out = words.join(near_words(words), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    out = common.save(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best")).alias("form"),
                                 F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    links = max(1, int(math.log(max(most / least_count, 1)) / math.log(ratio)) + 1)       # counts grow by the ratio at every link
    up = roots(out.where("form is not null"), math.ceil(math.log2(links)) + 1)
    return out.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = f"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS BIGINT)] || range(8),
        lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
x AS (SELECT *, lower(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w))) AS s FROM r),
h AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(1, strlen(s) // 2 + 1), lambda i:
        16 * (instr('0123456789abcdef', s[2 * i - 1]) - 1) + instr('0123456789abcdef', s[2 * i]) - 1),
        lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM x, tab),
t AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(w) >= {LEAST_LENGTH} GROUP BY w HAVING sum(n) >= {LEAST_COUNT}),
p AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
d AS (SELECT DISTINCT w, n, substr(w, 1, i - 1) || substr(w, i + 1) AS g FROM p),
m AS (SELECT w, n, substr(w, 1, i - 1) || '_' || substr(w, i + 1) AS g FROM p),
e AS (SELECT a.w, a.n, b.w AS o, b.n AS on_ FROM m a JOIN m b ON a.g = b.g AND a.w <> b.w
      UNION ALL SELECT d.w, d.n, v.w, v.n FROM d JOIN v ON v.w = d.g
      UNION ALL SELECT v.w, v.n, d.w, d.n FROM d JOIN v ON v.w = d.g),
f AS (SELECT w, any_value(n) AS n, count(*) AS n_near, arg_min(o, (-on_, o)) AS best, max(on_) AS best_n FROM e GROUP BY w),
k AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form,
        CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n FROM v LEFT JOIN f USING (w)),
z AS (WITH RECURSIVE up(word, root) AS (SELECT word, word FROM k UNION ALL
        SELECT up.word, k.form FROM up JOIN k ON k.word = up.root WHERE k.form IS NOT NULL)
      SELECT up.word, up.root FROM up JOIN k ON k.word = up.root WHERE k.form IS NULL)
SELECT k.word, k.n, k.n_near, k.form, k.form_n, z.root FROM k JOIN z USING (word)
"""
