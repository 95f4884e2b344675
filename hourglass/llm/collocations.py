"""Operator 13: phrases by a weighted de Bruijn graph.

Nodes are pairs of words, edges are triples (the longest grams), weighted by their
number.  Everything is per language and within pieces (texts cut at punctuation).

1. ``_edges``: each task counts the triples of its texts and packs them, sorted, by the
   bucket of their first node.  A piece's end is written as edges to nothing, (x, y, -) and
   (y, -, -): they are the corrections by which a node's flow is its exact count.
2. ``_flows``: a bucket holds all edges of its nodes.  Their sums give the edges' weights, and
   the flow out of a node is the pair's count; flows of nodes that begin with the same word
   add up to the word's count.  A word's nodes are spread over SPREAD buckets.
3. ``unary``: a node whose whole flow enters by one edge and leaves by one has that
   edge's count.  ``paths`` joins the edges along such nodes to one phrase each; in the
   candidates such a pair is inside a longer one of its own count and is left out at once.
4. Candidates are scored at their weakest cut with exact decimals; pairs inside a triple that has
   half their count go; each language's first LIMIT stay.

Only nodes and edges of at least ``least`` occurrences leave the buckets.

Null and empty texts: no pieces.  Null language: ``und``.  Repeated rows count again;
ids aren't read.  Long texts: pieces and words are handled in numpy, a batch of texts at
a time.  Empty table: no phrases.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, text

LEAST, LIMIT = 10, 2000
SPREAD = 8                 # buckets that share the nodes of one first word
BUCKETS = 8                # buckets a shuffle partition
BLOCK = 6 << 20            # bytes of texts whose edges are counted at once
U = np.uint64

_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True


def words_of(data: np.ndarray, o: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words, their documents, whether each is the last of its piece) of the texts' bytes."""
    data = text.LOWER[data]
    starts, ends, first = text.word_spans(data, o, _GAP)
    doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
    stops = np.append(0, np.cumsum(_STOP[data]))
    last = np.ones(len(starts), bool)
    last[:-1] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    raw = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)].tobytes()
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)), doc, last


PACKED = "bucket int, lang string, n int, size bigint, edges binary, counts binary"


def _pack(words: pa.StringArray, lang: np.ndarray, last: np.ndarray, langs: list[str], buckets: int) -> pa.RecordBatch:
    """PACKED: the different edges of some words and how often each occurs."""
    coded = words.dictionary_encode()
    own, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1          # 0: nothing
    d, o = text.utf8(own)
    hashes = text.word_hashes(d, o[:-1], o[1:])
    v = len(own) + 1
    second, third = np.zeros_like(code), np.zeros_like(code)
    second[:-1] = np.where(last[:-1], 0, code[1:])
    third[:-2] = np.where(last[:-2] | last[1:-1], 0, code[2:])
    nodes, node = np.unique((lang * v + code) * v + second, return_inverse=True)
    edges, n = np.unique(node * v + third, return_counts=True)
    node, z = nodes[edges // v], edges % v
    x, y, tongue = node // v % v, node % v, node // v // v
    salt = text.mix(np.array([hash_of(s) for s in langs], U))[tongue]
    near = text.mix(hashes[x - 1] + salt)
    spread = text.mix(near + np.append(U(0), hashes)[y]) % U(SPREAD)
    bucket = (text.mix(near + spread * text.GOLD) % U(buckets)).astype(np.int64)
    by = np.lexsort((z, y, x, tongue, bucket))
    bucket, tongue, n = bucket[by], tongue[by], n[by]
    named = pa.concat_arrays([pa.array([""], pa.string()), own])
    lines = pc.binary_join_element_wise(*(named.take(pa.array(c[by])) for c in (x, y, z)), "\n", " ")
    raw, at = text.utf8(lines)
    raw = raw.tobytes()
    new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (tongue[1:] != tongue[:-1])))
    end = np.append(new[1:], len(bucket))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[new].astype(np.int32)), pa.array([langs[k] for k in tongue[new]], pa.string()),
        pa.array((end - new).astype(np.int32)), pa.array(at[end] - at[new]),
        pa.array([pa.compress(raw[at[i]:at[j]], "zstd", asbytes=True) for i, j in zip(new, end)], pa.binary()),
        pa.array([pa.compress(n[i:j].astype("<i8").tobytes(), "zstd", asbytes=True) for i, j in zip(new, end)], pa.binary())],
        ["bucket", "lang", "n", "size", "edges", "counts"])


def hash_of(s: str) -> int:
    d = np.frombuffer(s.encode() or b"\0", np.uint8)
    return int(text.word_hashes(d, np.zeros(1, np.int64), np.full(1, len(d), np.int64))[0])


def _edges(buckets: int):
    """(lang, text) -> PACKED."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nonlocal size
            words = pa.concat_arrays([h[0] for h in held])
            names = pa.chunked_array([h[1] for h in held]).combine_chunks().dictionary_encode()
            lang, last = names.indices.to_numpy().astype(np.int64), np.concatenate([h[2] for h in held])
            held.clear()
            size = 0
            return _pack(words, lang, last, names.dictionary.to_pylist(), buckets)
        for b in batches:
            langs = pc.fill_null(b.column(0).cast(pa.string()), "und")
            d, o = text.utf8(b.column(1))
            for i, j in text.chunks(o):
                words, doc, last = words_of(d[o[i]:o[j]], o[i:j + 1] - o[i])
                if len(words):
                    held.append((words, langs.slice(i, j - i).take(pa.array(doc)), last))
                    size += int(o[j] - o[i])
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()
    return run


FLOWS = "lang string, x string, y string, z string, n bigint, flow bigint"


def _sums(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    np.add.at(out, group, n)
    return out


def _slices(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.StringArray:
    size = np.append(0, np.cumsum(hi - lo))
    at = np.arange(size[-1]) + np.repeat(lo - size[:-1], hi - lo)
    return pa.StringArray.from_buffers(len(lo), pa.py_buffer(size.astype(np.int32)), pa.py_buffer(d[at].tobytes()))


def _solve(lang: str, rows: list[tuple], least: int) -> pa.RecordBatch:
    """FLOWS of one bucket and language; ``rows``: (n, size, edges, counts)."""
    raw = b"".join(pa.decompress(e, size, "zstd", asbytes=True) for _, size, e, _ in rows)
    n = np.concatenate([np.frombuffer(pa.decompress(c, 8 * k, "zstd", asbytes=True), "<i8") for k, _, _, c in rows])
    stop = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A) + 1)
    lines = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(stop), pa.py_buffer(raw))
    t = pa.table({"e": lines, "n": n}).group_by("e").aggregate([("n", "sum")])
    d, o = text.utf8(t.column("e"))
    n = t.column("n_sum").to_numpy()
    gap = (o[0] + np.flatnonzero(d[o[0]:o[-1]] == 0x20)).reshape(-1, 3)                  # after x, y and z
    x, y, z = _slices(d, o[:-1], gap[:, 0]), _slices(d, gap[:, 0] + 1, gap[:, 1]), _slices(d, gap[:, 1] + 1, gap[:, 2])
    cx, cy = (c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (x, y))
    _, at, node = np.unique(cx * (len(n) + 1) + cy, return_index=True, return_inverse=True)
    flow = _sums(node, n)
    _, first, word = np.unique(cx, return_index=True, return_inverse=True)
    share = _sums(word, n)
    edge = np.flatnonzero((gap[:, 2] > gap[:, 1] + 1) & (n >= least))
    alone = np.zeros(len(flow), bool)                                                    # its whole flow leaves by one edge
    alone[node[edge[n[edge] == flow[node[edge]]]]] = True
    pair = np.flatnonzero((flow >= least) & ~alone & (gap[at, 1] > gap[at, 0] + 1))
    size = len(edge), len(pair), len(share)
    some = np.concatenate([edge, at[pair], first])
    kind = np.repeat([3, 2, 1], size)
    take = [c.take(pa.array(some, mask=kind < k)) for k, c in ((1, x), (2, y), (3, z))]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), *take, pa.array(np.concatenate([n[edge], flow[pair], share])),
                                       pa.array(np.concatenate([flow[node[edge]], flow[pair], share]))], ["lang", "x", "y", "z", "n", "flow"])


def _flows(least: int):
    """PACKED sorted by (bucket, lang) -> FLOWS: edges (x, y, z), nodes (x, y) and shares of words (x);
    edges and nodes of at least ``least`` occurrences.  An edge has its first node's flow
    beside it; a node whose whole flow leaves by one edge is known from that edge and not given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for bucket, lang, *row in zip(*cols):
                if rows and (bucket, lang) != now:
                    yield _solve(now[1], rows, least)
                    rows = []
                now = bucket, lang
                rows.append(tuple(row))
        if rows:
            yield _solve(now[1], rows, least)
    return run


def graph(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The weighted graph, saved: edges (lang, x, y, z, n, flow), nodes (lang, x, y, n) and words
    (lang, x, n); edges and nodes of at least ``least`` occurrences, words all."""
    spark = docs.sparkSession
    common.ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(lang_col, text_col).mapInArrow(_edges(BUCKETS * parts), PACKED)
    flows = packed.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_flows(least), FLOWS)
    flows = common.save(flows, "flows")
    edges = flows.where("z is not null")
    nodes = flows.where("z is null and y is not null").select("lang", "x", "y", "n").unionByName(
        edges.where("n = flow").select("lang", "x", "y", "n"))
    words = common.save(flows.where("y is null").groupBy("lang", "x").agg(F.sum("n").alias("n")), "words")
    return edges, nodes, words


def _gram(*cols: str):
    return F.concat_ws(" ", *cols)


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, n): the edges joined along unary nodes, whose whole flow enters by one edge and leaves
    by one, so that all edges of a path have the count ``n``.  (A piece has a first and a last word,
    so such nodes never form a ring.)"""
    node = nodes.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("f"))
    into = edges.join(node, ["lang", "y", "z"]).where("n = f").select("lang", _gram("x", "y", "z").alias("before"), _gram("y", "z").alias("v"))
    out = edges.where("n = flow").select("lang", _gram("x", "y", "z").alias("e"), _gram("x", "y").alias("v"))
    link = out.join(into, ["lang", "v"]).select("lang", "e", "before")
    at = edges.select("lang", "n", "z", _gram("x", "y", "z").alias("e")).join(link, ["lang", "e"], "left")
    at = common.save(at.select("lang", "n", "z", "e", F.coalesce("before", "e").alias("head"), F.col("before").isNotNull().cast("int").alias("steps")), "steps")
    while True:                                                                          # steps double: log2 of the longest path
        up = at.select("lang", F.col("e").alias("head"), F.col("head").alias("_h"), F.col("steps").alias("_s")).where("_s > 0")
        moving = at.where("steps > 0").join(up, ["lang", "head"], "left")
        if moving.where("_s is not null").isEmpty():
            break
        moving = moving.select("lang", "n", "z", "e", F.coalesce("_h", "head").alias("head"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"))
        at = common.save(at.where("steps = 0").unionByName(moving), "steps")
    rest = F.transform(F.array_sort(F.collect_list(F.struct("steps", "z"))), lambda s: s["z"])
    joined = at.groupBy("lang", "head").agg(F.max("n").alias("n"), rest.alias("rest"))
    return joined.select("lang", F.concat_ws(" ", F.col("head"), F.slice("rest", F.lit(2), F.size("rest"))).alias("phrase"), "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of two or three words."""
    edges, nodes, words = graph(docs, lang_col, text_col, least)
    inside = (edges.select("lang", "x", "y", "n").unionByName(edges.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "n"))
              .groupBy("lang", "x", "y").agg(F.max("n").alias("m")))
    pairs = nodes.join(inside, ["lang", "x", "y"], "left").where("m is null or 100 * m < 50 * n")
    pairs = pairs.select("lang", _gram("x", "y").alias("phrase"), "x", F.col("y").alias("z"), F.col("n").alias("a"),
                         F.lit(None).cast("bigint").alias("head"), F.lit(None).cast("bigint").alias("tail"))
    tails = nodes.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("tail"))
    triples = edges.join(tails, ["lang", "y", "z"]).select("lang", _gram("x", "y", "z").alias("phrase"), "x", "z", F.col("n").alias("a"),
                                                           F.col("flow").alias("head"), "tail")
    common_words = words.where(F.col("n") >= least)
    both = pairs.unionByName(triples).join(common_words.select("lang", "x", F.col("n").alias("fx")), ["lang", "x"])
    both = both.join(common_words.select("lang", F.col("x").alias("z"), F.col("n").alias("fz")), ["lang", "z"])

    def score(left: str, right: str):
        wide = [F.col(c).cast("decimal(16,0)") for c in ("a", left, right)]
        up, down = (wide[0] * wide[0] * F.lit(1000000).cast("decimal(7,0)")), wide[1] * wide[2]
        return F.call_function("div", up, down)
    both = both.withColumn("r1", F.coalesce("tail", "fz")).withColumn("s1", score("fx", "r1")).withColumn("s2", score("head", "fz"))
    second = F.col("s2") < F.col("s1")                                                   # null for pairs
    best = both.select("lang", "phrase", "a", F.when(second, F.col("head")).otherwise(F.col("fx")).alias("l"),
                       F.when(second, F.col("fz")).otherwise(F.col("r1")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, w[i:i + k - 1] AS ws
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) k(k))),
f AS MATERIALIZED (SELECT lang, k, g, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
x AS MATERIALIZED (SELECT lang, g, f FROM f WHERE k < 3 AND f >= {LEAST}),
o AS MATERIALIZED (SELECT lang, g, f, k, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
      FROM (SELECT c.*, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT o.lang, o.g AS phrase, o.k, o.f AS a, cut, a.f AS l, b.f AS r,
        CAST(1000000::HUGEINT * o.f * o.f // (CAST(a.f AS HUGEINT) * b.f) AS BIGINT) AS score
      FROM o JOIN x a ON a.lang = o.lang AND a.g = o.head JOIN x b ON b.lang = o.lang AND b.g = o.tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS g, f FROM c WHERE k = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM c WHERE k = 3) GROUP BY lang, g),
z AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.g = m.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * m.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
JOIN n USING (lang) WHERE rank <= {LIMIT}
"""
