"""Operator 3: removal of repeated passages with an enhanced suffix array.

A byte is removed if it lies in a ``length``-byte string that also starts
earlier (smaller key, or same document and earlier place); strings never cross
documents and are judged on the input.  That is the union, over all maximal
repeats of at least ``length`` bytes, of all occurrences but the first.

How: every ``length``-byte string has one anchor, the least of its K-byte hashes
(leftmost of equals), so equal strings have equal anchors at equal places.  The
strings of a document fall into runs with one anchor; a run's *context* is the
bytes they cover (under 2 * length).

1. ``_anchor_rows``: one small row (anchor, context hash, key, place) a run.
2. ``_same_context``: rows sorted by (anchor, context); runs with an equal
   context are removed but for the first.  An anchor with one context is done; the first run of each
   context of the others goes on, with its bytes fetched from the documents.
3. ``interval_tree``: over the suffixes of one anchor's contexts, an enhanced
   suffix array (suffix order and common prefixes) is scanned with a stack; each
   interval of the common-prefix tree of at least ``length`` whose members have
   different bytes to the left (or a context's edge) is a maximal repeat, given
   with all its occurrences, of which the first stays.

Skew: an anchor that a sample of documents shows to be frequent is dealt out by
(anchor, key); its rows then always go on to the next step, so the sample
decides only where rows go.  An anchor with over HOT contexts is not gathered:
its strings are compared one by one as (hash, key, place) rows in sorted order, each string's
places first in DEALT parts.

Null and empty texts: no bytes, nothing removed.  Repeated rows, repeated or
null ids: separate documents in the order of ``with_key``.  Very long texts: cut in overlapping segments
inside a task.  Empty table: empty result.  Other columns are not read; a
clashing name does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text
from .common import KEY

LENGTH = 100
K = 20
SEGMENT = 8 << 20          # bytes of one document handled at a time; under 2**24
HOT = 4096                 # contexts of one anchor that are gathered in a task
SAMPLE_DOCS = 4000         # documents looked at for frequent anchors
FREQUENT = 0.01            # share of the sampled documents that makes an anchor frequent
U = np.uint64
_PLACE = U(0xFFFFFF)


def anchor_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the pieces data[begins:ends] (ascending, apart): (piece, first
    string, last string, anchor's place, anchor's hash); places in ``data``."""
    none = np.zeros(0, np.int64)
    grams = text.kgram_hashes(data, K)
    if len(data) < length or not len(grams):
        return none, none, none, none, np.zeros(0, U)
    number = np.flatnonzero(ends > begins)            # empty pieces share a place with the next
    own = begins[number]
    at = np.zeros(len(grams), np.int64)
    at[own[own < len(grams)]] = 1
    at = np.cumsum(at) - 1
    inside = np.arange(len(grams)) - own[at]
    least = text.sliding_min((grams & ~_PLACE) | inside.astype(U), length - K + 1)
    p = at[:len(least)]
    ok = np.arange(len(least)) + length <= ends[number[p]]
    s = np.flatnonzero(ok)
    if not len(s):
        return none, none, none, none, np.zeros(0, U)
    new = np.ones(len(s), bool)
    new[1:] = (least[s[1:]] != least[s[:-1]]) | (p[s[1:]] != p[s[:-1]])
    q = np.flatnonzero(new)
    lo, hi = s[q], s[np.append(q[1:] - 1, len(s) - 1)]
    place = own[p[lo]] + (least[lo] & _PLACE).astype(np.int64)
    return number[p[lo]], lo, hi, place, grams[place]


ANCHOR_SCHEMA = f"a bigint, c bigint, {KEY} bigint, lo bigint, n int, off int"


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = text.utf8(b.column(1))
            keys = np.asarray(b.column(0))
            for i, j in text.chunks(o):
                for begin in range(int(o[i]), max(int(o[j]), int(o[i]) + 1), SEGMENT):
                    # one segment holds whole rows, or a part of a long row that owns the strings starting in it
                    stop = min(int(o[j]), begin + SEGMENT + length - 1)
                    data = d[begin:stop]
                    begins = np.maximum(o[i:j], begin) - begin
                    ends = np.maximum(np.minimum(o[i + 1:j + 1], stop) - begin, begins)
                    piece, lo, hi, place, a = anchor_runs(data, begins, ends, length)
                    if not len(lo):
                        continue
                    view = data.tobytes()
                    off = place - lo
                    end = hi + length
                    c = np.fromiter(map(xxhash.xxh3_64_intdigest, (view[x:y] for x, y in zip(lo.tolist(), end.tolist())),
                                        off.tolist()), U, len(lo))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys[i + piece]),
                        pa.array(lo + begin - o[i + piece]), pa.array((end - lo).astype(np.int32)),
                        pa.array(off.astype(np.int32))], ["a", "c", KEY, "lo", "n", "off"])
    return run


FOUND_SCHEMA = f"more boolean, a bigint, {KEY} bigint, lo bigint, n int, off int"


def _same_context(frequent: np.ndarray):
    """Over rows sorted by (a, c, key, lo): repeats of a context (more=false), and
    each context's first row where the anchor has several (more=true).  What is
    kept between batches is one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a = last_c = held = None                     # held: the only context so far of the last anchor

        def rows(more, x):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x[0]), more))] + [pa.array(v) for v in x], ["more", "a", KEY, "lo", "n", "off"])

        for b in batches:
            if not b.num_rows:
                continue
            a, c, *rest = (np.asarray(b.column(k)) for k in range(6))
            cols = [a, *rest]
            new_a, new_c = np.ones(len(a), bool), np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
            new_a[0] = last_a is None or a[0] != last_a
            new_c[0] = new_a[0] or c[0] != last_c
            if not new_c.all():
                yield rows(False, [v[~new_c] for v in cols])
            group = np.cumsum(new_a)                      # 0: the group that goes on from the batch before
            firsts = np.bincount(group[new_c], minlength=int(group[-1]) + 1)
            many = firsts >= 2
            many[0] = firsts[0] > 0
            many |= np.isin(np.append(a[:1], a[new_a]), frequent)
            if firsts[0] and held is not None:
                yield rows(True, held)
            go = new_c & many[group]
            if go.any():
                yield rows(True, [v[go] for v in cols])
            end = int(group[-1])
            if end or firsts[0]:
                held = None
            if end and not many[end]:
                i = int(np.flatnonzero(new_c)[-1])
                held = [v[i:i + 1] for v in cols]
            last_a, last_c = a[-1], c[-1]
    return run


def interval_tree(buf: np.ndarray, begins: np.ndarray, group: np.ndarray, key: np.ndarray, lo: np.ndarray,
                  length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``length`` bytes among contexts of the same
    group: (length, rows of their occurrences, places in the contexts), the first
    occurrence (least key and place) in front.

    ``buf`` holds the contexts, ``begins`` their bounds.
    """
    size = np.diff(begins)
    n = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    s = begins[row] + place
    hashed = text.kgram_hashes(buf, length)[s] ^ text.mix(group.astype(np.int64).view(U))[row]
    _, cls, count = np.unique(hashed, return_inverse=True, return_counts=True)
    # a class whose members all continue one class to the left belongs to a longer repeat
    left = np.where(place > 0, np.append(-1, cls[:-1]), -1 - np.arange(len(cls)))
    low, high = np.full(len(count), len(cls)), np.full(len(count), -len(cls) - 1)
    np.minimum.at(low, cls, left)
    np.maximum.at(high, cls, left)
    keep = np.flatnonzero((count[cls] >= 2) & (low[cls] != high[cls]))
    if not len(keep):
        return
    s, row, place, cls = s[keep], row[keep], place[keep], cls[keep]
    before = np.where(place > 0, buf[np.maximum(s - 1, 0)].astype(np.int64), -1 - np.arange(len(s)))
    for size, at in _scan(buf, s, begins[row + 1], cls, before, key[row], lo[row] + place, length):
        yield size, row[at], place[at]


def _scan(buf: np.ndarray, s: np.ndarray, stop: np.ndarray, cls: np.ndarray, before: np.ndarray, key: np.ndarray,
          start: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats among the suffixes buf[s:stop], of which those of one class
    share ``length`` bytes: (length, members), the least (key, start) in front.  ``before``:
    the byte to the left, or a negative number of its own at an edge."""
    raw = buf.tobytes()
    tails = [raw[x + length:y] for x, y in zip(s.tolist(), stop.tolist())]
    order = np.array(sorted(range(len(s)), key=lambda i: (cls[i], tails[i])), np.int64)
    s, cls, stop = s[order], cls[order], stop[order]
    lcp = np.zeros(len(s), np.int64)
    for x in range(1, len(s), 4096):                      # common prefix with the suffix before, on the bytes
        y = min(x + 4096, len(s))
        span = np.arange(int(np.max(stop[x - 1:y] - s[x - 1:y])))
        p, q = s[x - 1:y - 1, None] + span, s[x:y, None] + span
        same = (p < stop[x - 1:y - 1, None]) & (q < stop[x:y, None])
        same &= buf[np.minimum(p, len(buf) - 1)] == buf[np.minimum(q, len(buf) - 1)]
        lcp[x:y] = np.where(same.all(1), len(span), np.argmin(same, 1)) * (cls[x:y] == cls[x - 1:y - 1])
    before = before[order].tolist()
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((start[order], key[order]))] = np.arange(len(s))
    rank = rank.tolist()
    stack: list[list] = []                                # [lcp, first suffix, left byte or None, least rank's suffix]

    def closed(top, end):
        if top[2] is None:                                # members differ to the left
            at = np.arange(top[1], end)
            at = np.concatenate(([top[3]], at[at != top[3]]))
            return top[0], order[at]
        return None

    steps = lcp.tolist() + [0]
    for i in range(1, len(s) + 1):
        start, byte, best = i - 1, before[i - 1], i - 1
        while stack and stack[-1][0] > steps[i]:
            top = stack.pop()
            top[2] = top[2] if top[2] == byte else None
            top[3] = min(top[3], best, key=rank.__getitem__)
            if (found := closed(top, i)) is not None:
                yield found
            start, byte, best = top[1], top[2], top[3]
        if steps[i] < length:
            continue
        if stack and stack[-1][0] == steps[i]:
            top = stack[-1]
            top[2] = top[2] if top[2] == byte else None
            top[3] = min(top[3], best, key=rank.__getitem__)
        else:
            stack.append([steps[i], start, byte, best])


CONTEXTS = 8192            # contexts taken together by one interval tree; whole groups


def _repeats(length: int):
    """Rows (a, key, lo, ctx) sorted by a -> spans of the occurrences to remove."""
    def solve(a, key, lo, ctx):
        begins = np.zeros(len(ctx) + 1, np.int64)
        np.cumsum([len(x) for x in ctx], out=begins[1:])
        buf = np.frombuffer(b"".join(ctx), np.uint8)
        k, st, ln = [], [], []
        for size, rows, places in interval_tree(buf, begins, a, key, lo, length):
            rows, places = rows[1:], places[1:]
            k.append(key[rows])
            st.append(lo[rows] + places)
            ln.append(np.full(len(rows), size))
        if not k:
            return None
        k, st, ln = (np.concatenate(x).astype(np.int64) for x in (k, st, ln))
        far = np.lexsort((-ln, st, k))                    # the longest from each place
        far = far[np.append(True, (k[far][1:] != k[far][:-1]) | (st[far][1:] != st[far][:-1]))]
        return pa.RecordBatch.from_arrays([pa.array(k[far]), pa.array(st[far]), pa.array(st[far] + ln[far])],
                                          [KEY, "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0

        def gather():
            a, key, lo = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(3))
            return a, key, lo, [x for b in held for x in b.column(3).to_pylist()]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= CONTEXTS:
                a, key, lo, ctx = gather()
                cut = int(np.searchsorted(a, a[-1]))      # the last group may go on
                if cut and (out := solve(a[:cut], key[:cut], lo[:cut], ctx[:cut])) is not None:
                    yield out
                held = [pa.RecordBatch.from_arrays([pa.array(a[cut:]), pa.array(key[cut:]), pa.array(lo[cut:]),
                                                    pa.array(ctx[cut:], pa.binary())], ["a", KEY, "lo", "ctx"])]
                rows = len(a) - cut
        if held and (out := solve(*gather())) is not None:
            yield out
    return run


def _strings(length: int):
    """Every string of a context as (two hashes, key, place)."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, lo = np.asarray(b.column(1)), np.asarray(b.column(2))
            ctx = b.column(3).to_pylist()
            begins = np.zeros(len(ctx) + 1, np.int64)
            np.cumsum([len(x) for x in ctx], out=begins[1:])
            buf = np.frombuffer(b"".join(ctx), np.uint8)
            n = np.diff(begins) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            s = begins[row] + place
            head = text.kgram_hashes(buf, length)[s]
            tail = text.kgram_hashes(buf ^ np.uint8(0xA5), length)[s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(key[row]),
                 pa.array(lo[row] + place)], ["w1", "w2", KEY, "lo"])
    return run


STRINGS = f"w1 bigint, w2 bigint, {KEY} bigint, lo bigint"
DEALT = 64                 # parts in which the places of one string are first compared


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (w1, w2, key, lo): the rows with ``later``, true for all but the first of each string."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        w1, w2 = np.asarray(b.column(0)), np.asarray(b.column(1))
        again = np.zeros(len(w1), bool)
        again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        again[0] = last == (w1[0], w2[0])
        last = (w1[-1], w2[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(again)], names=[*b.schema.names, "later"])


def _later(strings: DataFrame) -> DataFrame:
    """Places of strings (STRINGS) that start earlier.  A frequent string's places
    are first compared in DEALT parts; only the first of each part meet."""
    def marked(rows, *by):
        return (rows.repartition(*by).sortWithinPartitions("w1", "w2", KEY, "lo").mapInArrow(_marked, STRINGS + ", later boolean"))
    parts = common.save(marked(strings, F.xxhash64("w1", F.pmod(F.xxhash64(KEY), F.lit(DEALT)))), "strings")
    firsts = marked(parts.where("not later").drop("later"), "w1")
    return parts.where("later").union(firsts.where("later")).select(KEY, "lo")


SPAN_SCHEMA = f"{KEY} bigint, lo bigint, hi bigint"


def _contexts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of repeated contexts, contexts that need their bytes with the number of their anchor)."""
    rows = docs.select(KEY, "_hgl_text").mapInArrow(_anchor_rows(length), ANCHOR_SCHEMA)
    total = docs.count()
    frequent = np.zeros(0, np.int64)
    if total:
        part = docs.sample(min(1.0, SAMPLE_DOCS / total), seed=7).select(KEY, "_hgl_text")
        seen = (part.mapInArrow(_anchor_rows(length), ANCHOR_SCHEMA).select("a", KEY).distinct()
                .groupBy("a").count().where(F.col("count") >= max(8, FREQUENT * min(total, SAMPLE_DOCS))))
        frequent = np.array([r["a"] for r in seen.select("a").collect()], np.int64)  # at most anchors a document / FREQUENT
    deal = F.xxhash64("a")
    if len(frequent):
        marks = docs.sparkSession.createDataFrame([(int(x),) for x in frequent], "a bigint").withColumn("_f", F.lit(True))
        rows = rows.join(F.broadcast(marks), "a", "left")
        deal = F.when(F.col("_f"), F.xxhash64("a", KEY)).otherwise(deal)
    dealt = rows.withColumn("_p", deal).repartition("_p").sortWithinPartitions("a", "c", KEY, "lo")
    found = common.save(dealt.select("a", "c", KEY, "lo", "n", "off")
                        .mapInArrow(_same_context(frequent), FOUND_SCHEMA), "contexts")
    spans = found.where(~F.col("more")).select(KEY, "lo", (F.col("lo") + F.col("n")).alias("hi"))
    more = found.where("more")
    crowd = more.groupBy("a").count().where(F.col("count") > HOT).select("a", F.lit(True).alias("crowd"))
    return spans, more.join(crowd, "a", "left")


def _with_bytes(more: DataFrame, docs: DataFrame) -> DataFrame:
    return (more.join(docs.select(KEY, "_hgl_text"), KEY)
            .select("a", KEY, "lo", F.expr("substring(cast(_hgl_text as binary), cast(lo as int) + 1, n)").alias("ctx"), "crowd"))


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, lo, hi): byte spans whose union is what is to be removed; ``docs``
    has KEY and _hgl_text."""
    spans, more = _contexts(docs, length)
    more = _with_bytes(more, docs)
    tree = (more.where("crowd is null").drop("crowd").repartition("a").sortWithinPartitions("a", KEY, "lo")
            .mapInArrow(_repeats(length), SPAN_SCHEMA))
    strings = more.where("crowd").drop("crowd").mapInArrow(_strings(length), STRINGS)
    crowd = _later(strings).select(KEY, "lo", (F.col("lo") + length).alias("hi"))
    return spans.union(common.save(tree.union(crowd), "repeats"))


INTERVALS = "repeat string, n bigint, a bigint, c bigint, place bigint"


def _named(found, raw: bytes, s: np.ndarray, a: np.ndarray, c: np.ndarray, place: np.ndarray):
    """INTERVALS of (length, members); a member that is given twice comes once."""
    names, n, who = [], [], []
    for size, at in found:
        at = np.unique(at)
        names += [xxhash.xxh3_128_hexdigest(raw[s[at[0]]:s[at[0]] + size])] * len(at)
        n.append(np.full(len(at), size, np.int64))
        who.append(at)
    if not who:
        return None
    who = np.concatenate(who)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())] + [pa.array(x) for x in (np.concatenate(n), a[who], c[who], place[who])],
                                      ["repeat", "n", "a", "c", "place"])


def _class_repeats(length: int):
    """Suffixes (SUFFIXES) sorted by (w1, w2) -> INTERVALS.  Whole classes are held: ints and at
    most 2 * length - K bytes a suffix of a distinct context."""
    def solve(t: pa.Table):
        w1, w2, a, c, place, key, start, left = (t.column(k).to_numpy() for k in range(8))
        twice, tails = t.column(8).to_numpy(), t.column(9).to_pylist()
        begins = np.zeros(len(tails) + 1, np.int64)
        np.cumsum([len(x) for x in tails], out=begins[1:])
        raw = b"".join(tails)
        cls = np.cumsum(np.append(0, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        at = np.concatenate((np.arange(len(w1)), np.flatnonzero(twice)))     # a copied context meets itself
        count = np.bincount(cls[at])
        at = at[count[cls[at]] >= 2]
        if not len(at):
            return None
        before = np.where(left[at] < 0, -1 - np.arange(len(at)), left[at])
        found = _scan(np.frombuffer(raw, np.uint8), begins[at], begins[at + 1], cls[at], before, key[at], start[at], length)
        return _named(((size, at[x]) for size, x in found), raw, begins[:-1], a, c, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, CONTEXTS
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                last = t.column(0).to_numpy()
                cut = int(np.searchsorted(last, last[-1]))                   # the last class may go on
                if cut and (out := solve(t.slice(0, cut))) is not None:
                    yield out
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
                enough = max(CONTEXTS, 2 * rows)
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out
    return run


def _anchor_repeats(length: int):
    """Contexts (a, c, key, lo, twice, ctx) sorted by a -> INTERVALS; their classes are made in the task."""
    split, solve = _suffixes(length), _class_repeats(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def anchors():                                                       # batches of whole anchors
            held: list = []
            for b in batches:
                if not b.num_rows:
                    continue
                held.append(b)
                t = pa.Table.from_batches(held).combine_chunks()
                a = t.column(0).to_numpy()
                cut = int(np.searchsorted(a, a[-1]))
                if cut:
                    yield from t.slice(0, cut).to_batches()
                held = t.slice(cut).to_batches()
            yield from held

        for b in split(anchors()):
            by = np.lexsort((np.asarray(b.column(1)), np.asarray(b.column(0))))
            yield from solve(iter([b.take(pa.array(by))]))
    return run


SUFFIXES = f"w1 bigint, w2 bigint, a bigint, c bigint, place bigint, {KEY} bigint, lo bigint, before int, twice boolean, tail binary"


def _suffixes(length: int):
    """Every suffix of at least ``length`` bytes of a context, with two hashes of its first ``length`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c, key, lo, twice = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            ctx = b.column(5).to_pylist()
            begins = np.zeros(len(ctx) + 1, np.int64)
            np.cumsum([len(x) for x in ctx], out=begins[1:])
            raw = b"".join(ctx)
            buf = np.frombuffer(raw, np.uint8)
            n = np.diff(begins) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            s = begins[row] + place
            head = text.kgram_hashes(buf, length)[s]
            tail = text.kgram_hashes(buf ^ np.uint8(0xA5), length)[s]
            left = np.where(place > 0, buf[np.maximum(s - 1, 0)].astype(np.int32), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (head.view(np.int64), tail.view(np.int64), a[row], c[row], place, key[row], lo[row] + place, left,
                                       twice[row])]
                + [pa.array([raw[x:y] for x, y in zip(s.tolist(), begins[row + 1].tolist())], pa.binary())],
                ["w1", "w2", "a", "c", "place", KEY, "lo", "before", "twice", "tail"])
    return run


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(repeat, n, key, lo): every occurrence of every maximal repeat among the
    runs' contexts (at most 2 * length - K bytes a piece; a longer passage comes as
    overlapping pieces); ``repeat`` is a 128-bit hash of the piece's bytes.

    A piece holds its anchor, so all its occurrences are runs of that anchor, one each.
    Repeats are found among the distinct contexts (one that occurs again also repeats
    itself) and joined back to all runs with these contexts.  The contexts of an anchor
    with over HOT of them are dealt out by the string they share, not by anchor.  No sample is used.
    """
    common.ready(docs.sparkSession)
    keyed = common.with_key(docs, id_col, text_col).withColumn("_hgl_text", F.col(text_col))
    runs = common.save(keyed.select(KEY, "_hgl_text").mapInArrow(_anchor_rows(length), ANCHOR_SCHEMA), "runs")
    first = F.min(F.struct(KEY, "lo", "n"))
    contexts = runs.groupBy("a", "c").agg(first.alias("f"), (F.count(F.lit(1)) > 1).alias("twice")).select("a", "c", "f.*", "twice")
    contexts = common.save(contexts, "contexts")
    anchors = (contexts.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).where("k > 1 or t")
               .select("a", (F.col("k") > HOT).alias("crowd")))
    more = common.save(contexts.join(anchors, "a").join(keyed.select(KEY, "_hgl_text"), KEY).select(
        "a", "c", KEY, "lo", "twice", F.expr("substring(cast(_hgl_text as binary), cast(lo as int) + 1, n)").alias("ctx"), "crowd"), "bytes")
    few = (more.where("not crowd").drop("crowd").repartition("a").sortWithinPartitions("a", KEY, "lo")
           .mapInArrow(_anchor_repeats(length), INTERVALS))
    crowd = (more.where("crowd").drop("crowd").mapInArrow(_suffixes(length), SUFFIXES).repartition("w1", "w2")
             .sortWithinPartitions("w1", "w2", KEY, "lo").mapInArrow(_class_repeats(length), INTERVALS))
    found = common.save(few.union(crowd), "intervals")
    return found.join(runs.drop("n", "off"), ["a", "c"]).select("repeat", "n", KEY, (F.col("lo") + F.col("place")).alias("lo"))


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of (lo, hi) rows as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > far[:-1])
    q = np.flatnonzero(new)
    return np.stack([spans[q, 0], far[np.append(q[1:] - 1, len(spans) - 1)]], 1)


FIGURES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def cut(raw: bytes, lo: list[int] | None, hi: list[int] | None) -> tuple[bytes, int, bytes]:
    """(what the spans leave, number of runs removed, the same with whole characters)."""
    runs = merge(np.array([lo, hi], np.int64).T).tolist() if lo else []
    left, at, whole, whole_at = [], 0, [], 0
    for x, y in runs:
        left.append(raw[at:x])
        at = y
        while x < y and raw[x] & 0xC0 == 0x80:               # a character that is cut stays
            x += 1
        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        whole.append(raw[whole_at:x])
        whole_at = y
    return b"".join(left) + raw[at:], len(runs), b"".join(whole) + raw[whole_at:]


def _cut_rows(names: list[str], text_at: int, kept: list[int], keep_text: bool):
    """Rows (the documents' columns, key, spans' starts and ends) -> the columns ``kept`` and FIGURES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, lo, hi in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                raw = (t or "").encode()
                left, runs, whole = cut(raw, lo, hi)
                out.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), whole.decode() if runs else t))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(list(c), k) for c, k in zip(cols, kinds)][:4 + keep_text],
                                             names=names)
    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                keep_text: bool = True) -> DataFrame:
    """``docs`` with, per row, n_bytes, n_removed, n_spans, kept_sha256 (of the
    exact remaining bytes) and kept_text (whole characters; null stays null),
    as columns named ``_hgl_*``; without ``keep_text`` both texts are left out."""
    common.ready(docs.sparkSession)
    keyed = common.with_key(docs, id_col, text_col)
    plain = keyed.select(KEY, F.col(text_col).alias("_hgl_text"))

    def spans() -> DataFrame:
        return repeat_spans(plain, length).groupBy(KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select(
            KEY, F.col("s.lo").alias("_hgl_lo"), F.col("s.hi").alias("_hgl_hi"))
    joined = keyed.join(common.alone(spans, "spans"), KEY, "left").select(*docs.columns, KEY, "_hgl_lo", "_hgl_hi")
    text_at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    out = T.StructType([docs.schema[k] for k in kept] + [T.StructField(f"_hgl_{f}", t) for f, t in zip(FIGURES, kinds)][:4 + keep_text])
    return joined.mapInArrow(_cut_rows(out.names, text_at, kept, keep_text), out)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, {2 * LENGTH})) AS g
      FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - {LENGTH - 2})) AS i FROM d)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
      (SELECT *, CAST(i - lag(i, 1, -{LENGTH}) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH} AS INTEGER) AS fresh FROM f)),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + {LENGTH - 1} AS hi FROM g GROUP BY doc_id, run),
p AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM r),
k AS (SELECT doc_id, h, count(lo) AS n_spans, coalesce(sum(hi - lo + 1), 0) AS n_removed,
        coalesce(string_agg(substr(h, 2 * before + 1, 2 * (lo - 1 - before)), '' ORDER BY lo), '')
        || substr(h, 2 * coalesce(max(hi), 0) + 1) AS kept
      FROM d LEFT JOIN p USING (doc_id) GROUP BY doc_id, h)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
