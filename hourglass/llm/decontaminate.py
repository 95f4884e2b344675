"""Operator 1: benchmark decontamination, in DataFrame functions only.

Words are lower-cased (A-Z) runs of digits, a-z and characters beyond ASCII.  A
benchmark item's windows are its WORDS-word sequences (all of a shorter
item's words as one).  The windows' hashes are broadcast; every window of a
document is hashed and looked up as it is generated, and a hit is verified on the words
themselves.  The big side isn't shuffled: what leaves the scan is one row a document
and one a verified hit, and those are gathered per document.

The windows are broadcast up to BROADCAST_WINDOWS of them (they are
counted); beyond that the documents' windows are joined by two hashes (128 bits) in a
shuffled join.

Null text: no words.  Null item ids: their windows count as hits, the id is not listed.  Repeated
rows, null or repeated ids: rows in the order of ``common.with_key``, each with its
own result.  Other columns aren't read.  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import KEY

WORDS = 10
BROADCAST_WINDOWS = 500_000      # about 100 bytes each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hash(array: Column, start: Column, n: int, seed: int = 0) -> Column:
    """Hash of ``n`` words from ``start``; nulls (past the end) don't count."""
    return F.xxhash64(F.lit(seed), *(F.get(array, start + k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(size, window, items, h, h2): distinct windows with the ids they occur in."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = w.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("size")).select(
        "item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("s"))
    window = at.select("item", "size", F.slice("w", F.col("s") + 1, F.col("size")).alias("v"))
    return (window.groupBy("size", "v").agg(F.collect_set("item").alias("items"))
            .select("size", F.concat_ws(" ", "v").alias("window"), "items",
                    _hash(F.col("v"), F.lit(0), n).alias("h"), _hash(F.col("v"), F.lit(0), n, 1).alias("h2")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (with KEY): KEY, the id, n_words, spans (start, size of hit windows, sorted) and items."""
    bench = common.save(benchmark_windows(benchmark, item_col, item_text_col, n), "windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())     # at most n
    count = bench.count()
    base = docs.select(KEY, F.col(id_col).alias("_hgl_id"), words(F.col(text_col)).alias("w"))
    base = base.select(KEY, "_hgl_id", "w", F.size("w").alias("n"))
    least = sizes[0] if sizes else n
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - least, F.lit(0)))).alias("s"))
    large = count > BROADCAST_WINDOWS
    if len(sizes) > 1:
        rows = rows.select("*", F.explode(F.array(*(F.lit(k) for k in sizes))).alias("size"))
    else:
        rows = rows.withColumn("size", F.lit(least))

    def hashed(seed):
        pick = [F.when(F.col("size") == k, _hash(F.col("w"), F.col("s"), k, seed)) for k in sizes] or [F.lit(None).cast("bigint")]
        return F.when(F.col("s") + F.col("size") <= F.col("n"), F.coalesce(*pick) if len(sizes) != 1 else _hash(
            F.col("w"), F.col("s"), sizes[0], seed))

    first = (F.col("s") == 0) & (F.col("size") == least)
    b = bench.select(F.col("size").alias("b_size"), "window", "items", "h", "h2")
    if not large:
        rows = rows.withColumn("x", hashed(0))
        same = ((F.col("x") == F.col("h")) & (F.col("size") == F.col("b_size"))
                & (F.concat_ws(" ", F.slice("w", F.col("s") + 1, F.col("size"))) == F.col("window")))
        found = rows.join(F.broadcast(b), same, "left").where(F.col("items").isNotNull() | first)
    else:
        thin = rows.select(KEY, "_hgl_id", "n", "s", "size", hashed(0).alias("x"), hashed(1).alias("y"))
        hits = thin.join(b.hint("merge"), (F.col("x") == F.col("h")) & (F.col("y") == F.col("h2")) & (F.col("size") == F.col("b_size")))
        none = base.select(KEY, "_hgl_id", "n", F.lit(0).alias("s"), F.lit(least).alias("size"),
                           F.lit(None).cast("array<string>").alias("items"))
        found = hits.select(*none.columns).union(none)
    span = F.when(F.col("items").isNotNull(), F.struct("s", "size"))
    return (found.groupBy(KEY, "_hgl_id").agg(
        F.max("n").cast("bigint").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def n_hit(spans: str = "spans") -> Column:
    """Words covered by sorted (start, size) spans."""
    return F.expr(f"""aggregate({spans}, named_struct('n', 0L, 'e', 0),
        (a, x) -> named_struct('n', a.n + greatest(0, x.s + x.size - greatest(a.e, x.s)), 'e', greatest(a.e, x.s + x.size)),
        a -> a.n)""")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           spans: bool = False, **names) -> DataFrame:
    """``docs`` without contaminated documents, or (``spans``) with their hit words
    and the separators before them cut out of the text."""
    keyed = common.with_key(docs, id_col, text_col)
    hit = contamination(keyed, benchmark, id_col, text_col, **names).where(F.size("spans") > 0).select(KEY, "spans")
    if not spans:
        return keyed.join(hit, KEY, "left_anti").drop(KEY)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?:(?!{RAW_WORD})[\\s\\S])*{RAW_WORD}+"), F.lit(0))
    kept = F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda p: ~F.exists(
        "_hgl_spans", lambda v: (p["i"] >= v["s"]) & (p["i"] < v["s"] + v["size"])))
    tail = F.regexp_extract(F.col(text_col), f"((?:(?!{RAW_WORD})[\\s\\S])*)$", 1)
    cut = F.concat(F.array_join(F.transform(kept, lambda p: p["t"]), ""), tail)
    out = keyed.join(hit.withColumnRenamed("spans", "_hgl_spans"), KEY, "left")
    return out.withColumn(text_col, F.when(F.col("_hgl_spans").isNull(), F.col(text_col)).otherwise(cut)).drop("_hgl_spans", KEY)


_W = r"regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[s:s + least(len(w), {WORDS}) - 1] AS v FROM
       (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WORDS}) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(v) AS k FROM bw),
d AS (SELECT row_number() OVER () AS id, doc_id, {_W} AS w FROM documents),
dw AS (SELECT id, s, k, w[s:s + k - 1] AS v FROM
       (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT id, s, k, item FROM dw JOIN bw USING (v)),
p AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(s, s + k)) AS j FROM hit) GROUP BY id),
i AS (SELECT id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.id = d.id LEFT JOIN i ON i.id = d.id
"""
