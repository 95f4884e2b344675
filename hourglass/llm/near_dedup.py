"""Operator 9: near-duplicate groups by fast similarity sketches.

Two documents are linked if the Jaccard similarity of their sets of distinct
5-word shingles is at least 0.75; a group is a component of these links.

Sketch (fast similarity sketching): T bins; in round i every shingle goes to a
random bin with the value (i, hash), and a bin keeps its least value.  After T
random rounds, round T + j sends all shingles to bin j, so every bin fills; bins
stay unbiased, and concentrate as those of T independent permutations.  Rounds
stop once all bins are full, about T ln T / set size of them.

1. ``sketch_rows``: per document the set's size and hash, BANDS band hashes of
   ROWS bins each, and one byte a bin to estimate similarity.
2. Equal sets are one class (its least key stands for it).
3. Classes with an equal band are candidates.  First each is compared with the
   least of its band ("star"); groups that arise are one from then on, so a large
   group of near copies costs its size, not its square.  Classes that still share a band with
   a class of another group get a second sketch, of DEEP_BANDS bands of DEEP_ROWS bins,
   which pairs under the limit seldom share.  Classes of *different* groups in
   one of its bands, of sizes that can be similar, are compared by one bit a bin
   where the band lies, and only those over DEEP_FLOOR (4 standard deviations under the
   limit) become pairs.  A band of over CROWD classes is not gathered: its pairs across
   groups come from joins.
4. A candidate with an estimate over FLOOR (5 standard deviations under the limit)
   is confirmed on the full sets, which are made only for documents in
   such candidates.

At the limit of 0.75 a link shares no band of the first sketch in 3 of 100,000 cases, none of
the second in 7, and is under DEEP_FLOOR in 3; above, fewer.

Null and empty texts: empty set, linked with nothing, kept.  Fewer than five
words: one shingle of all words.  Repeated rows, null or repeated ids: rows in
the order of ``common.with_key``.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text
from .common import KEY

WORDS = 5
SIMILAR = 75               # percent
ROWS, BANDS = 7, 72
T = ROWS * BANDS
DEEP_ROWS, DEEP_BANDS = 12, 300
DEEP_DOCS = 128            # second sketches made at a time
DEEP_FLOOR = 0.705
CROWD = 1024               # classes of one band compared in a task
FLOOR = 0.65
WORK = 1 << 18             # sketch values made at a time
U = np.uint64
_FULL = U(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, o: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted."""
    data = text.LOWER[data]
    starts, ends, first = text.word_spans(data, o)
    h = text.word_hashes(data, starts, ends)
    n = np.diff(first)
    many = np.maximum(n - words + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
    value = np.zeros(len(at), U)
    for k in range(words):
        value += h[at + k] * text.COEF[k]
    few = np.flatnonzero((n > 0) & (n < words))
    short = np.zeros(len(few), U)
    for k in range(words - 1):
        has = n[few] > k
        short[has] += h[first[few[has]] + k] * text.COEF[k]
    short += n[few].astype(U) * text.GOLD
    row, value = np.append(row, few), text.mix(np.append(value, short))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def sketch(row: np.ndarray, value: np.ndarray, n: int, bins: int = T) -> np.ndarray:
    """Sketches (n x bins) of the sets given as sorted (row, value); an empty set's bins stay full of ones."""
    out = np.full(n * bins, _FULL, U)
    i = 0
    while len(row) and i < bins:
        step = int(min(max(1, WORK // len(row)), bins - i))
        rounds = np.arange(i, i + step, dtype=U)
        x = text.mix(value[None, :] + (rounds[:, None] + U(1)) * text.GOLD)
        at = (((x & U(0xFFFF)) * U(bins)) >> U(16)).astype(np.int64) + row[None, :] * bins
        np.minimum.at(out, at.ravel(), ((rounds[:, None] << U(48)) | (x >> U(16))).ravel())
        i += step
        open_ = (out.reshape(n, bins) == _FULL).any(1)
        go = open_[row]
        row, value = row[go], value[go]
    while len(row) and i < 2 * bins:
        step = int(min(max(1, WORK // len(row)), 2 * bins - i))
        rounds = np.arange(i, i + step, dtype=U)
        x = text.mix(value[None, :] + (rounds[:, None] + U(1)) * text.GOLD)
        at = row[None, :] * bins + (rounds[:, None] - U(bins)).astype(np.int64)
        np.minimum.at(out, at.ravel(), ((rounds[:, None] << U(48)) | (x >> U(16))).ravel())
        i += step
    return out.reshape(n, bins)


def band_hashes(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = s.reshape(len(s), -1, rows)
    h = np.zeros(parts.shape[:2], U)
    for k in range(rows):
        h += text.mix(parts[:, :, k]) * text.COEF[k]
    return text.mix(h + np.arange(parts.shape[1], dtype=U) * text.GOLD)


SKETCH_SCHEMA = f"{KEY} bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, bytes binary"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, o = text.utf8(b.column(1))
        keys = np.asarray(b.column(0))
        for i, j in text.chunks(o):
            row, value = shingles(d[o[i]:o[j]], o[i:j + 1] - o[i])
            m = j - i
            n = np.bincount(row, minlength=m)
            s = sketch(row, value, m)
            s1, s2 = np.zeros(m, U), np.zeros(m, U)
            has = np.flatnonzero(n)
            if len(has):
                at = (np.cumsum(n) - n)[has]
                s1[has] = np.add.reduceat(text.mix(value + text.COEF[20]), at)
                s2[has] = np.add.reduceat(text.mix(value ^ text.COEF[21]), at)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * BANDS), _signed(band_hashes(s).ravel()))
            small = (text.mix(s) & U(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[i:j]), pa.array(n.astype(np.int64)), _signed(s1), _signed(s2), bands,
                 pa.array([r.tobytes() for r in small], pa.binary())], [KEY, "n", "s1", "s2", "bands", "bytes"])


def deep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bands of the second sketch, a bit of each of its bins)."""
    for b in batches:
        d, o = text.utf8(b.column(1))
        keys = np.asarray(b.column(0))
        for x, y in text.chunks(o):
            for i in range(x, y, DEEP_DOCS):
                j = min(i + DEEP_DOCS, y)
                row, value = shingles(d[o[i]:o[j]], o[i:j + 1] - o[i])
                value = text.mix(value ^ text.COEF[22])
                order = np.lexsort((value, row))
                s = sketch(row[order], value[order], j - i, DEEP_ROWS * DEEP_BANDS)
                at = np.arange(j - i + 1, dtype=np.int32) * DEEP_BANDS
                bits = np.packbits((text.mix(s) & U(1)).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.ListArray.from_arrays(
                    pa.array(at), _signed(band_hashes(s, DEEP_ROWS).ravel())),
                    pa.array([r.tobytes() for r in bits], pa.binary())], [KEY, "bands", "bits"])


def alike(key: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of classes of different roots whose sizes and bits (rows of 64-bit words) are close enough."""
    least = int(np.ceil((1 + DEEP_FLOOR) / 2 * DEEP_ROWS * DEEP_BANDS))
    first, second = [], []
    for i in range(len(key) - 1):
        j = np.flatnonzero((root[i + 1:] != root[i]) & (np.minimum(n[i + 1:], n[i]) * 100 >= np.maximum(n[i + 1:], n[i]) * SIMILAR)) + i + 1
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
        j = j[DEEP_ROWS * DEEP_BANDS - differ >= least]
        first.append(np.full(len(j), i))
        second.append(j)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _band_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (band, key, root, n, bits) sorted by band, bands of at most CROWD rows: pairs u < v."""
    width = -(-DEEP_ROWS * DEEP_BANDS // 64) * 8
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        band, key, root, n = (rows.column(k).to_numpy() for k in range(4))
        bits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows.column(4).to_pylist()), U).reshape(len(band), -1)
        cut = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else np.zeros(0, np.int64)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(cut, np.append(cut[1:], len(band))):
            i, j = alike(key[x:y], root[x:y], n[x:y], bits[x:y])
            u.append(np.minimum(key[x + i], key[x + j]))
            v.append(np.maximum(key[x + i], key[x + j]))
        both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 4 * CROWD:
            rows = pa.Table.from_batches(held)
            band = rows.column(0).to_numpy()
            last = int(np.searchsorted(band, band[-1]))      # the last band may go on
            if last:
                yield pairs(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield pairs(pa.Table.from_batches(held))


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shingle hashes of the whole text)."""
    for b in batches:
        d, o = text.utf8(b.column(1))
        keys = np.asarray(b.column(0))
        for i, j in text.chunks(o):
            row, value = shingles(d[o[i]:o[j]], o[i:j + 1] - o[i])
            at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.ListArray.from_arrays(pa.array(at), _signed(value))],
                                             [KEY, "set"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps (u, v) whose sketches agree in enough bins; a byte agrees by chance once in 256."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, T) for k in (2, 3))
            same = (x == y).mean(1)
            yield b.select([0, 1]).filter(pa.array((same - 1 / 256) / (1 - 1 / 256) >= FLOOR))


BROADCAST_KEYS = 500_000   # keys (8 bytes each) that may be broadcast


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Key and text of the documents in ``keys`` (distinct, written)."""
    keys = keys.select(KEY)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.select(KEY, "_hgl_text").join(keys, KEY, "left_semi")


def _several(placed: DataFrame) -> DataFrame:
    """Rows (band, key, root, ...) of the bands with more than one root."""
    split = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
    return placed.join(split, "band")


def _cross(cells: DataFrame) -> DataFrame:
    """Pairs (u < v) of different roots in one band whose sizes can be similar;
    cells: (band, key, root, n)."""
    kinds = cells.select("band", "root").distinct()
    roots = (kinds.select("band", F.col("root").alias("ru")).join(kinds.select("band", F.col("root").alias("rv")), "band")
             .where("ru < rv"))
    member = lambda r, c: cells.select("band", F.col("root").alias(r), F.col(KEY).alias(c), F.col("n").alias(f"n{c}"))
    fit = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * SIMILAR
    return (roots.join(member("ru", "x"), ["band", "ru"]).join(member("rv", "y"), ["band", "rv"]).where(fit)
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())


def _confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) among candidate pairs."""
    side = lambda c: sketches.select(F.col(KEY).alias(c), F.col("n").alias(f"n{c}"), F.col("bytes").alias(f"b{c}"))
    fit = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * SIMILAR)
    likely = common.save(pairs.join(side("u"), "u").join(side("v"), "v").where(fit).select("u", "v", "bu", "bv")
                         .mapInArrow(_estimate, "u bigint, v bigint"), "likely")
    wanted = common.save(likely.select(F.col("u").alias(KEY)).union(likely.select(F.col("v").alias(KEY))).distinct(), "wanted")
    sets = common.save(_only(docs, wanted).mapInArrow(set_rows, f"{KEY} bigint, set array<bigint>"), "sets")
    both = (likely.join(sets.select(F.col(KEY).alias("u"), F.col("set").alias("su")), "u")
            .join(sets.select(F.col(KEY).alias("v"), F.col("set").alias("sv")), "v"))
    inter = F.size(F.array_intersect("su", "sv"))
    return (both.withColumn("x", inter)
            .where(F.col("x") * 100 >= (F.size("su") + F.size("sv") - F.col("x")) * SIMILAR).select("u", "v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating
    large and small stars; every round is written to the shared folder."""
    edges = common.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = common.save(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct())
        small = common.save(small, "small")
        if edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def _memberships(plain: DataFrame) -> DataFrame:
    """(KEY, _hgl_n, _hgl_root) of rows (KEY, _hgl_text): the set's size and the group's first key."""
    rows = common.save(plain.mapInArrow(sketch_rows, SKETCH_SCHEMA), "sketches")
    full = rows.where("n > 0")
    classes = common.save(full.groupBy("n", "s1", "s2").agg(F.min(KEY).alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias(KEY)), KEY, "left_semi")
    bands = reps.select(KEY, F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min(KEY).alias("u"), F.count(F.lit(1)).alias("size")).where("size > 1")
    cells = common.save(bands.join(shared, "band").select("band", KEY, "u"), "cells")
    star = cells.where(F.col(KEY) > F.col("u")).select("u", F.col(KEY).alias("v")).distinct()
    links = common.save(_confirmed(star, reps, plain), "star")
    root = components(links)
    # classes that still share a band with another group
    placed = cells.select("band", KEY).join(root, cells[KEY] == root["node"], "left").select(
        "band", KEY, F.coalesce("root", KEY).alias("root"))
    apart = common.save(_several(placed).select(KEY, "root").distinct().join(reps.select(KEY, "n"), KEY), "apart")
    deep = common.save(_only(plain, apart).mapInArrow(deep_rows, f"{KEY} bigint, bands array<bigint>, bits binary"), "deep")
    placed = common.save(_several(deep.select(KEY, F.explode("bands").alias("band")).join(apart, KEY)), "placed")
    crowd = placed.groupBy("band").count().where(F.col("count") > CROWD).select("band", F.lit(True).alias("crowd"))
    placed = placed.join(crowd, "band", "left")
    near = (placed.where("crowd is null").join(deep.select(KEY, "bits"), KEY).select("band", KEY, "root", "n", "bits")
            .repartition("band").sortWithinPartitions("band").mapInArrow(_band_pairs, "u bigint, v bigint"))
    rest = near.union(_cross(placed.where("crowd").drop("crowd"))).distinct()
    rest = common.save(rest.join(star, ["u", "v"], "left_anti"), "rest")
    more = _confirmed(rest, reps, plain)
    root = components(links.union(more))
    return (rows.select(KEY, "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
            .join(root, F.col("rep") == F.col("node"), "left")
            .select(KEY, F.col("n").alias("_hgl_n"), F.coalesce("root", "rep", KEY).alias("_hgl_root")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus _hgl_n (set size), _hgl_component (id of the first row of the
    group) and _hgl_kept (it is that row)."""
    spark = docs.sparkSession
    common.ready(spark)
    keyed = common.with_key(docs, id_col, text_col).withColumn("_hgl_text", F.col(text_col))
    plain = keyed.select(KEY, "_hgl_text")
    member_of = common.alone(lambda: _memberships(plain), "members")
    ids = keyed.select(F.col(KEY).alias("_hgl_root"), F.col(id_col).alias("_hgl_component"))
    member_of = member_of.join(ids, "_hgl_root").select(
        KEY, "_hgl_n", "_hgl_component", (F.col("_hgl_root") == F.col(KEY)).alias("_hgl_kept"))
    return keyed.drop("_hgl_text").join(member_of, KEY).drop(KEY)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN both_ways b ON b.x = r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
