"""Operator 4: quality rules of documents and of their hosts.

``facts`` counts, per document, what the rules look at (vectorised in the task, one
pass over whole texts, no shuffle).  ``host_verdicts`` adds up the rules' failures by
host, fits a beta prior to the hosts' rates by moments, and shrinks each rate
towards it: (failed + a) / (documents + a + b).  A host is rejected when a shrunk rate
is over LIMIT.  ``judge`` joins the verdicts back.

Sums by host are added up in the tasks first, so a host with a third of all
rows is one row a task.  The verdicts are one short row a host; Spark picks the
join by their measured size and splits a skewed host.  Facts are made twice (for the hosts,
for the documents), which costs less than shuffling all texts.

Null and empty text: no words, base_failed.  Null host: a host of its own.  Repeated
rows and null ids: rows stay as they are, judged one by one.  Other columns
pass through; results are named ``_hgl_*``.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text

SYMBOLS = b"#*$%&|<>"
LIMIT = 0.5                # greatest shrunk failure rate of a host that is kept
LEAST_PRIOR, MOST_PRIOR = 2.0, 1e6     # bounds of the prior's weight in documents
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
U = np.uint64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def count_facts(data: np.ndarray, o: np.ndarray, raw: list[bytes]) -> list[np.ndarray]:
    """FACTS of rows given as bytes with offsets, and as byte strings."""
    starts, ends, first = text.word_spans(data, o)
    n = np.diff(first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[o[1:]] - total[o[:-1]]

    chars = per_row(~text.SPACE[data] & ((data & 0xC0) != 0x80)) if len(data) else np.zeros(len(n), np.int64)
    symbols = per_row(_SYMBOL[data]) if len(data) else np.zeros(len(n), np.int64)
    h = text.word_hashes(data, starts, ends)
    many = np.maximum(n - 2, 0)
    row = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
    value = text.mix(h[at] * text.COEF[0] + h[at + 1] * text.COEF[1] + h[at + 2] * text.COEF[2]) if len(at) else np.zeros(0, U)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = np.zeros(len(r) + 1, bool)
    same[1:-1] = (r[1:] == r[:-1]) & (v[1:] == v[:-1]) if len(r) else False
    twice = at[order[same[1:] | same[:-1]]] if len(r) else at
    hit = np.zeros(len(h) + 1, np.int64)
    for k in range(3):
        hit[twice + k] = 1
    hits = np.append(0, np.cumsum(hit[:-1]))
    repeat = hits[first[1:]] - hits[first[:-1]]
    dup, lines = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k, t in enumerate(raw):
        own = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[k], dup[k] = len(own), len(own) - len(set(own))
    return [n, chars, symbols, dup, repeat, lines]


def facts(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` plus _hgl_<fact> columns; one row per row."""
    common.ready(docs.sparkSession)
    names = [c for c in docs.columns if not (drop_text and c == text_col)]
    at = docs.columns.index(text_col)
    out = T.StructType([docs.schema[c] for c in names] + [T.StructField(f"_hgl_{f}", T.LongType()) for f in FACTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = text.utf8(b.column(at))
            kept = [k for k, c in enumerate(b.schema.names) if not (drop_text and k == at)]
            for i, j in text.chunks(o):
                data, offs = d[o[i]:o[j]], o[i:j + 1] - o[i]
                view = data.tobytes()
                found = count_facts(data, offs, [view[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(f.astype(np.int64)) for f in found],
                                                 names=out.names)
    return docs.mapInArrow(run, out)


def rules() -> dict[str, Column]:
    """Rule name -> true where a document fails it."""
    c = {f: F.col(f"_hgl_{f}") for f in FACTS}
    return {
        "few_words": c["n_words"] < 50,
        "repeated_words": 100 * c["n_repeat_words"] > 50 * c["n_words"],
        "symbols": 10 * c["n_symbols"] > c["n_words"],
        "repeated_lines": 10 * c["n_dup_lines"] > 3 * c["n_lines"],
        "word_length": (c["word_chars"] < 3 * c["n_words"]) | (c["word_chars"] > 10 * c["n_words"]),
    }


def host_verdicts(facts_of: DataFrame, host_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """(host, n documents, one shrunk rate a rule, host_kept)."""
    named = rules()
    hosts = common.save(facts_of.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(v).alias(f"f_{k}") for k, v in named.items())), "host_counts")
    rate = {k: F.col(f"f_{k}") / F.col("n") for k in named}
    prior = hosts.agg(*(x for k in named for x in (F.avg(rate[k]).alias(f"m_{k}"), F.var_samp(rate[k]).alias(f"v_{k}"))))
    of = prior.first()                               # one row
    kept, shrunk = F.lit(True), []
    for k in named:
        m, v = of[f"m_{k}"] or 0.0, of[f"v_{k}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1 if v > 0 else MOST_PRIOR, LEAST_PRIOR), MOST_PRIOR)
        r = (F.col(f"f_{k}") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
        shrunk.append(r.alias(f"rate_{k}"))
        kept = kept & (r <= limit)
    return hosts.select("host", "n", *shrunk, kept.alias("host_kept"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", drop_text: bool = False,
          limit: float = LIMIT) -> DataFrame:
    """``docs`` with _hgl_<fact>, _hgl_base_failed and _hgl_kept."""
    hosts = host_verdicts(facts(docs.select(host_col, text_col), text_col, True), host_col, limit)
    named = rules()
    base = named["few_words"] | named["repeated_words"]
    hosts = hosts.select(F.col("host").alias("_hgl_host"), F.col("host_kept").alias("_hgl_host_kept"))
    out = facts(docs, text_col, drop_text)
    return (out.join(hosts, out[host_col].eqNullSafe(hosts["_hgl_host"]), "left")
            .withColumns({"_hgl_base_failed": base, "_hgl_kept": ~base & F.coalesce(F.col("_hgl_host_kept"), F.lit(True))})
            .drop("_hgl_host", "_hgl_host_kept"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
RATE = "(f_{k} + m_{k} * w_{k}) / (n + w_{k})"
_NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")
_WEIGHT = ("least(greatest(case when v_{k} > 0 then m_{k} * (1 - m_{k}) / v_{k} - 1 else 1e6 end, 2.0), 1e6)")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM t WHERE c > 1) GROUP BY id),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
s AS (SELECT id, count(*) AS lines, count(DISTINCT line) AS diff FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id),
f AS (SELECT d.id, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines - diff, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lines, 0) AS n_lines
      FROM d LEFT JOIN r ON r.id = d.id LEFT JOIN s ON s.id = d.id),
x AS (SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeated_words,
        10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS repeated_lines,
        word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length FROM f),
h AS (SELECT source, count(*) AS n, {', '.join(f'count(*) FILTER ({k}) AS f_{k}' for k in _NAMES)} FROM x GROUP BY source),
m AS (SELECT {', '.join(f'avg(f_{k} / n) AS m_{k}, coalesce(var_samp(f_{k} / n), 0) AS v_{k}' for k in _NAMES)} FROM h),
q AS (SELECT *, {', '.join(_WEIGHT.format(k=k) + f' AS w_{k}' for k in _NAMES)} FROM m),
g AS (SELECT source, {' AND '.join(RATE.format(k=k) + f' <= {LIMIT}' for k in _NAMES)} AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  few_words OR repeated_words AS base_failed, NOT (few_words OR repeated_words) AND host_kept AS kept
FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source
"""
