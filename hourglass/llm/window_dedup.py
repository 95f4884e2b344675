"""Operator 11: removal of repeated word windows by super-k-mer partitioning.

A word is removed if a window of ``window`` consecutive words that covers it also
starts earlier (smaller key, or same document and earlier start); windows never
cross documents and are judged on the input.

A window's *minimiser* is the least hash of its SEED-word pieces (the leftmost of
equals), so equal windows have equal minimisers.  Consecutive windows with one
minimiser are a *super-k-mer*: about seven windows that travel as one string
of their words instead of seven.

1. ``_super_kmers``: a small row (minimiser, document, start, windows) each.
2. Minimisers that occur once hold no repeat: only the others' super-k-mers are cut
   from their documents and travel, packed, to the minimiser's bucket.
3. ``_sorted_buckets``: a bucket's windows are sorted by a hash; neighbours with equal
   hashes are compared word for word, so counts are exact.
4. Minimisers of over HOT super-k-mers (of a passage in many documents) are dealt to as many
   buckets as they need.  Each gives the first occurrence of each of its windows; of
   these, one row a bucket and window, the least by two 64-bit hashes is the window's first.
5. The repeats' spans are merged and cut from each document.

Null and empty texts and texts of fewer than ``window`` words: nothing is removed.
Repeated rows, null or repeated ids: separate documents in the order of
``common.with_key``.  Long texts go in parts of SEGMENT words that overlap.  Empty
table: empty result.  Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text
from .common import KEY

WINDOW = 20
SEED = 8                   # words of a minimiser
HOT = 4096                 # super-k-mers of one minimiser that are sorted together, about
SEGMENT = 1 << 20          # words of one document handled at a time
FLUSH = 2 << 20            # bytes of packed words sorted at once (or one minimiser's)
U = np.uint64
_PLACE = U(0xFFFFFF)
_MORE = text.mix(np.arange(5001, 5065, dtype=U) * text.GOLD) | U(1)


def _sums(h: np.ndarray, k: int, coef: np.ndarray) -> np.ndarray:
    """A hash of each ``k`` neighbours of ``h``."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U)
    for j in range(k):
        out += h[j:j + len(out)] * coef[j % len(coef)] + coef[(j * 7 + 3) % len(coef)]
    return text.mix(out)


def runs(h: np.ndarray, doc: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of the word hashes ``h`` of documents ``doc`` (ascending): (first window's
    word, number of windows, minimiser's hash)."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, U)
    grams = _sums(h, seed, text.COEF)
    ordered = (grams & ~_PLACE) | np.arange(len(grams)).astype(U)       # leftmost of equals
    least = text.sliding_min(ordered, window - seed + 1)
    s = np.flatnonzero(doc[:len(least)] == doc[window - 1:])
    if not len(s):
        return none, none, np.zeros(0, U)
    new = np.ones(len(s), bool)
    new[1:] = (least[s[1:]] != least[s[:-1]]) | (doc[s[1:]] != doc[s[:-1]])
    first = np.flatnonzero(new)
    return s[first], np.diff(np.append(first, len(s))), grams[(least[s[first]] & _PLACE).astype(np.int64)]


KMERS = f"m bigint, {KEY} bigint, start int, n int"


def _super_kmers(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = text.utf8(b.column(1))
            keys = np.asarray(b.column(0))
            for i, j in text.chunks(o):
                data = d[o[i]:o[j]]
                starts, ends, first = text.word_spans(data, o[i:j + 1] - o[i])
                h = text.word_hashes(data, starts, ends)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                for x in range(0, max(len(h) - window + 1, 0), SEGMENT):
                    part = slice(x, x + SEGMENT + window - 1)
                    at, n, m = runs(h[part], doc[part], window, seed)
                    at = at + x
                    yield pa.RecordBatch.from_arrays([
                        pa.array(m.view(np.int64)), pa.array(keys[i + doc[at]]), pa.array((at - first[doc[at]]).astype(np.int32)),
                        pa.array(n.astype(np.int32))], ["m", KEY, "start", "n"])
    return run


PACKED = f"m bigint, part int, {KEY} bigint, start int, n int, words binary"


def normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins (and the end plus one)."""
    size = np.append(0, np.cumsum(ends - starts + 1))
    out = np.full(int(size[-1]), 0x20, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    to = np.ones(len(out), bool)
    to[size[1:] - 1] = False
    out[to] = data[word]
    return out.tobytes(), size


def _packed(window: int):
    """(key, text, its super-k-mers) -> PACKED."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = text.utf8(b.column(1))
            keys, lists = np.asarray(b.column(0)), b.column(2)
            for i, j in text.chunks(o):
                data = d[o[i]:o[j]]
                starts, ends, first = text.word_spans(data, o[i:j + 1] - o[i])
                raw, begin = normal(data, starts, ends)
                some = lists.slice(i, j - i)
                rows = some.flatten()
                doc = np.repeat(np.arange(j - i), np.asarray(some.value_lengths()))
                m, part, start, n = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                x = first[doc] + start
                lo, hi = begin[x], begin[x + n + window - 1] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(part), pa.array(keys[i + doc]), pa.array(start), pa.array(n),
                     pa.array([raw[p:q] for p, q in zip(lo.tolist(), hi.tolist())], pa.binary())],
                    ["m", "part", KEY, "start", "n", "words"])
    return run


class Windows:
    """All windows of some packed super-k-mers: their row, document, place, words and hash."""

    def __init__(self, t: pa.Table, window: int):
        m, part, key, start, n = (t.column(k).to_numpy() for k in range(5))
        packed = t.column(5).combine_chunks()
        size = np.append(0, np.cumsum(np.asarray(pa.compute.binary_length(packed)).astype(np.int64)))
        self.raw = b"".join(packed.to_pylist())
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends, first = text.word_spans(data, size)
        self.window, h = window, text.word_hashes(data, self.starts, self.ends)
        self.row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(self.row)) - (np.cumsum(n) - n)[self.row]
        self.word = first[self.row] + within
        new = np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1]))              # rows come by bucket
        self.bucket, self.split = (np.cumsum(new) - 1)[self.row], part[self.row] >= 0
        self.key, self.place = key[self.row], start[self.row] + within
        self.hash = _sums(h, window, text.COEF)[self.word]
        self.second = _sums(h, window, _MORE)[self.word] if len(h) else self.hash

    def words(self, k: np.ndarray) -> list[bytes]:
        lo, hi = self.starts[self.word[k]], self.ends[self.word[k] + self.window - 1]
        return [self.raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows sorted so that equal ones stand together in order of their occurrence, which of
        these begin a new group); hashes only bring neighbours together, words decide."""
        by = np.lexsort((self.place, self.key, self.hash, self.bucket))
        new = np.ones(len(by), bool)
        new[1:] = (self.hash[by[1:]] != self.hash[by[:-1]]) | (self.bucket[by[1:]] != self.bucket[by[:-1]])
        again = np.flatnonzero(~new)
        # a group is held against its first window, in parts
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        for x in range(0, len(again), 1 << 16):
            part = again[x:x + (1 << 16)]
            if any(p != q for p, q in zip(self.words(by[part]), self.words(by[head[part]]))):
                whole = self.words(np.arange(len(self.word)))               # two texts, one hash: sort by words
                by = np.array(sorted(range(len(whole)), key=lambda k: (self.bucket[k], whole[k], self.key[k], self.place[k])))
                new[1:] = [whole[p] != whole[q] or self.bucket[p] != self.bucket[q] for p, q in zip(by[1:], by[:-1])]
                break
        return by, new


FOUND = f"{KEY} bigint, lo int, hi int, w1 bigint, w2 bigint"
COUNTS = "words string, n bigint, split boolean"


def _spans(w: Windows) -> pa.RecordBatch:
    """What is covered by windows that aren't the first of their group, and the first windows of split buckets (with their hashes)."""
    by, new = w.sort()
    gone = np.zeros(len(by), bool)
    gone[by[~new]] = True
    k = np.flatnonzero(gone)
    fresh, last = np.ones(len(k), bool), np.ones(len(k), bool)
    fresh[1:] = (np.diff(k) > 1) | (w.row[k[1:]] != w.row[k[:-1]])
    last[:-1] = fresh[1:]
    first = np.flatnonzero(~gone & w.split)
    lo, hi = np.append(k[fresh], first), np.append(k[last], first)
    whole = np.arange(len(lo)) < len(lo) - len(first)
    return pa.RecordBatch.from_arrays([pa.array(w.key[lo]), pa.array(w.place[lo].astype(np.int32)), pa.array((w.place[hi] + w.window).astype(np.int32)),
                                       pa.array(w.hash[lo].view(np.int64), mask=whole), pa.array(w.second[lo].view(np.int64), mask=whole)],
                                      [KEY, "lo", "hi", "w1", "w2"])


def _counts(w: Windows) -> pa.RecordBatch:
    by, new = w.sort()
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(by)))
    first, n = first[(n > 1) | w.split[by[first]]], n[(n > 1) | w.split[by[first]]]
    return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in w.words(by[first])], pa.string()), pa.array(n), pa.array(w.split[by[first]])],
                                      ["words", "n", "split"])


def _sorted_buckets(window: int, solve):
    """Rows PACKED sorted by bucket -> ``solve`` of whole buckets, at least FLUSH bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, FLUSH
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(5).nbytes
            if size >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                m, part = t.column(0).to_numpy(), t.column(1).to_numpy()
                cut = int(np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1])))[-1])     # the last bucket may go on
                if cut:
                    yield solve(Windows(t.slice(0, cut), window))
                held = t.slice(cut).to_batches()
                size = sum(x.column(5).nbytes for x in held)
                enough = max(FLUSH, 2 * size)
        if held:
            yield solve(Windows(pa.Table.from_batches(held).combine_chunks(), window))
    return run


def packed(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The super-k-mers whose minimiser occurs again (PACKED; ``part`` -1: its bucket isn't split), saved;
    ``docs`` has KEY and _hgl_text."""
    def make() -> DataFrame:
        kmers = docs.mapInArrow(_super_kmers(window, seed), KMERS)               # made twice: less than to keep it
        twice = common.save(kmers.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "minimisers")
        part = F.when(F.col("c") > HOT, F.pmod(F.xxhash64(KEY, "start"), F.ceil(F.col("c") / HOT))).otherwise(-1).cast("int").alias("part")
        mine = kmers.join(twice, "m").select(KEY, "m", part, "start", "n").groupBy(KEY).agg(F.collect_list(F.struct("m", "part", "start", "n")).alias("k"))
        return docs.join(mine, KEY).select(KEY, "_hgl_text", "k").mapInArrow(_packed(window), PACKED)
    return common.alone(make, "packed")


def _buckets(travelling: DataFrame, window: int, solve, schema: str) -> DataFrame:
    return travelling.repartition("m", "part").sortWithinPartitions("m", "part").mapInArrow(_sorted_buckets(window, solve), schema)


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(key, lo, hi): word spans whose union is what is to be removed."""
    found = common.save(_buckets(packed(docs, window, seed), window, _spans, FOUND), "found")
    each = found.where("w1 is not null")
    first = common.save(each.groupBy("w1", "w2").agg(F.min(F.struct(KEY, "lo")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
                        .select("w1", "w2", "f"), "firsts")
    later = each.join(first, ["w1", "w2"]).where((F.col(KEY) != F.col(f"f.{KEY}")) | (F.col("lo") != F.col("f.lo")))
    return found.where("w1 is null").select(KEY, "lo", "hi").unionByName(later.select(KEY, "lo", "hi"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     seed: int = SEED) -> DataFrame:
    """(words, n): every window that occurs more than once, its words joined by one
    space, with the number of its occurrences."""
    common.ready(docs.sparkSession)
    keyed = common.with_key(docs.select(id_col, text_col), id_col, text_col).select(KEY, F.col(text_col).alias("_hgl_text"))
    counts = common.save(_buckets(packed(keyed, window, seed), window, _counts, COUNTS), "counts")
    split = counts.where("split").groupBy("words").agg(F.sum("n").alias("n")).where("n > 1")
    return counts.where("not split").select("words", "n").unionByName(split)


FIGURES = (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))


def _cut(names: list[str], text_at: int, kept: list[int], keep_text: bool):
    """Rows (the documents' columns, spans' starts and ends) -> the columns ``kept`` and FIGURES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = text.utf8(b.column(text_at))
            null = np.asarray(b.column(text_at).is_null())
            los, his = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            out = []
            for i, j in text.chunks(o):
                data = d[o[i]:o[j]]
                starts, ends, first = text.word_spans(data, o[i:j + 1] - o[i])
                cover = np.zeros(len(starts) + 1, np.int32)
                lo, hi = los.slice(i, j - i), his.slice(i, j - i)
                doc = np.repeat(np.arange(j - i), np.asarray(lo.value_lengths().fill_null(0)))
                np.add.at(cover, first[doc] + np.asarray(lo.flatten()), 1)
                np.add.at(cover, first[doc] + np.asarray(hi.flatten()), -1)
                stay = np.cumsum(cover[:-1]) == 0
                raw, begin = normal(data, starts[stay], ends[stay])
                left = np.append(0, np.cumsum(stay))[first]
                for k in range(j - i):
                    rest = raw[begin[left[k]]:max(begin[left[k + 1]] - 1, begin[left[k]])]
                    out.append((int(first[k + 1] - first[k]), int(first[k + 1] - first[k] - left[k + 1] + left[k]),
                                hashlib.sha256(rest).hexdigest(), None if null[i + k] else rest.decode()))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(list(c), t) for c, t in zip(cols, kinds)][:3 + keep_text],
                                             names=names)
    return run


def cut_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                keep_text: bool = True) -> DataFrame:
    """``docs`` with, per row, n_words, n_removed, kept_sha256 and kept_text (kept words joined by
    one space; null stays null) as columns ``_hgl_*``; without ``keep_text`` both texts are left out."""
    common.ready(docs.sparkSession)
    keyed = common.with_key(docs, id_col, text_col)
    plain = keyed.select(KEY, F.col(text_col).alias("_hgl_text"))

    def spans() -> DataFrame:
        return repeat_spans(plain, window, seed).groupBy(KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select(
            KEY, F.col("s.lo").alias("_hgl_lo"), F.col("s.hi").alias("_hgl_hi"))
    own = [f"_hgl_c{k}" for k in range(len(docs.columns))]
    joined = keyed.toDF(*own, KEY).join(common.alone(spans, "spans"), KEY, "left").select(*own, "_hgl_lo", "_hgl_hi")
    text_at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    out = T.StructType([docs.schema[k] for k in kept] + [T.StructField(f"_hgl_{f}", t) for f, t in FIGURES][:3 + keep_text])
    return joined.mapInArrow(_cut(out.names, text_at, kept, keep_text), out)


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM f),
k AS (SELECT d.doc_id, d.i, d.w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) d
      ANTI JOIN x ON x.doc_id = d.doc_id AND x.i = d.i),
s AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
