"""Operator 5: toxicity from a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: letters that look alike, accents and case, and digits or signs
that stand for letters inside words.  The lexicon (words, and stems of 4 to 6 letters
that match any ending) is learned from labelled rows: an entry's weight is
its log odds between toxic and other documents, and it is taken if that is clear of
chance (a lower bound over LEAST).  All entries are found in one pass; a word counts its
best entry, unless it stands in an exception phrase (given ones, and word pairs
that training rows show only in documents that are not toxic).  The sum of weights is
divided by the logarithm of the length, and a logistic curve, fitted to the training rows,
makes it a score.

Learning uses about SAMPLE labelled rows at most (by a hash of the id), of near copies the one of the least id; counts are summed in
tasks before the shuffle and at most ENTRIES entries are kept, so the model is small.
Scoring is one pass over all rows without a shuffle.

Null and empty texts score as a text without matches.  Rows stay one for one; repeated
rows and null ids are scored like others; null labels are not learned from.  Without any
toxic training row all scores are the training share, 0 if there are no labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .near_dedup import shingles
from .text import mix, utf8

SAMPLE = 20_000
ENTRIES = 5_000
MIN_DOCS = 3
LEAST = 1.5
STEMS = (4, 5, 6)
HASHES = 16                # least shingle hashes of a labelled row
AGREE = 12                 # equal ones that make it a near copy
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("авеёікмнорстухѕјԁɡαβεικνορτυχ", "abeeikmhopctyxsjdgabeikvoptux")
#: Digits and signs that stand for letters.
SUBSTITUTES = str.maketrans("013457@$", "oieastas")
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown")

_PART = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
_MIXED = re.compile(r"\S*(?:[a-z][0-9@$]|[0-9@$][a-z])\S*")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code).lower().translate(HOMOGLYPHS)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        out = "".join(c if c.isalnum() or c in "@$" else " " for c in base) if base else ""
        self[code] = out
        return out


_FOLD = _Fold()


def folded(t: str | None) -> str:
    """Folded words with one space before and after each."""
    t = (t or "").translate(_FOLD)
    if _PART.search(t):
        t = _MIXED.sub(lambda m: m.group().translate(SUBSTITUTES), t)
    return f" {' '.join(t.split())} "


def entries_of(t: str) -> set[str]:
    """Candidate entries: ' word ' and ' stem'."""
    words = set(t.split())
    out = {f" {w} " for w in words}
    out.update(f" {w[:k]}" for w in words for k in STEMS if len(w) > k)
    return out


class Matcher:
    """Sum of weights of a folded text's words, without those in exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick
        self.found, self.spared = ahocorasick.Automaton(), ahocorasick.Automaton()
        for e, w in weights.items():
            self.found.add_word(e, (len(e), w))
        for e in exceptions:
            self.spared.add_word(f" {e} ", len(e) + 2)
        for a in (self.found, self.spared):
            if len(a):
                a.make_automaton()

    def words(self, t: str) -> dict[int, float]:
        """Place of the space before a matched word -> weight."""
        best: dict[int, float] = {}
        if len(self.found):
            for end, (n, w) in self.found.iter(t):
                s = end - n + 1
                if w > best.get(s, -math.inf):
                    best[s] = w
        if best and len(self.spared):
            for end, n in self.spared.iter(t):
                for s in range(end - n + 1, end):
                    best.pop(s, None)
        return best

    def value(self, t: str) -> float:
        return sum(self.words(t).values()) / math.log(math.e + t.count(" ") - 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, toxic) with the least values of the text's 5-word shingles under HASHES hashes."""
    salts = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
    for b in batches:
        d, o = utf8(b.column(1))
        row, value = shingles(d[o[0]:o[-1]], o - o[0])
        sig = np.zeros((b.num_rows, HASHES), np.uint64)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for k, salt in enumerate(salts):
                sig[row[first], k] = np.minimum.reduceat(mix(value ^ salt), first)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, HASHES, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "text", "toxic", "sig"])


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(id, text, toxic) without near copies of the same label, so that words of one copied text don't
    pass for words of many.  A row goes if a row of a lesser id has AGREE of its HASHES least shingle
    hashes; documents that only share a passage agree in fewer and stay.  Rows with all hashes equal
    become one before any are compared, so many copies of a text don't meet in one task."""
    kind = T.StructType([*(rows.schema[c] for c in ("id", "text", "toxic")), T.StructField("sig", T.ArrayType(T.LongType()))])
    one = common.save(rows.select("id", "text", "toxic").mapInArrow(_signed, kind).groupBy("toxic", "sig")
                      .agg(F.min(F.struct("id", "text")).alias("f")).select("f.id", "f.text", "toxic", "sig"), "signed")
    place = F.struct("id", F.xxhash64("text").alias("h"))
    bins = one.select(place.alias("at"), "toxic", "sig", F.posexplode("sig").alias("j", "v"))
    first = (bins.groupBy("toxic", "j", "v").agg(F.min(F.struct("at", "sig")).alias("f"), F.count(F.lit(1)).alias("k"))
             .where("k > 1").select("toxic", "j", "v", F.col("f.at").alias("at0"), F.col("f.sig").alias("sig0")))
    agree = F.aggregate(F.zip_with("sig", "sig0", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    again = (bins.join(first, ["toxic", "j", "v"]).where((F.col("at0") < F.col("at")) & (agree >= AGREE))
             .select("at.id", "at.h", "toxic").distinct())
    return common.save(one.withColumn("h", F.xxhash64("text")).join(again, ["id", "h", "toxic"], "left_anti")
                       .select("id", "text", "toxic"), "distinct")


def _counted(batches: Iterator[pa.RecordBatch], candidates) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows -> (entry, toxic documents, other documents), summed by task."""
    both = (Counter(), Counter())

    def flush():
        names = list(both[0].keys() | both[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string())] + [
            pa.array([c[e] for e in names], pa.int64()) for c in (both[1], both[0])], ["entry", "pos", "neg"])
        both[0].clear(), both[1].clear()
        return out

    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            both[y].update(candidates(folded(t)))
            if len(both[0]) + len(both[1]) > 500_000:
                yield flush()
    yield flush()


_COUNTS = "entry string, pos bigint, neg bigint"


def _totals(sample: DataFrame, candidates) -> DataFrame:
    return (sample.select("text", "toxic").mapInArrow(lambda x: _counted(x, candidates), _COUNTS)
            .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small penalty on the slope."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    a, b = 0.0, math.log(share / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = float(((p - y) * x).sum() + 1e-3 * a), float((p - y).sum() + 1e-3 * b)
        haa, hab, hbb = float((w * x * x).sum()) + 1e-3, float((w * x).sum()), float(w.sum()) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
        sample: int = SAMPLE, entries: int = ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """The model from documents and (id, label) rows: weights, exceptions, slope and offset."""
    common.ready(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)
    known = known.where(place < share)           # about ``sample`` rows, of however many: broadcast
    rows = common.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                       .join(F.broadcast(known), "id"), "labelled")
    distinct = distinct_rows(rows)
    n = {r["toxic"]: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)          # of the same rows as the entries' counts
    if not pos or not neg:
        return {"weights": {}, "exceptions": [], "slope": 0.0, "offset": 30.0 if pos else -30.0}
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    low = odds - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    kept = (_totals(distinct, entries_of).where(F.col("pos") >= F.lit(max(MIN_DOCS, pos // 200))).select("entry", odds.alias("w"), low.alias("low"))
            .where(F.col("low") >= LEAST).orderBy(F.desc("low"), "entry").limit(entries))
    weights = {r["entry"]: float(r["w"]) for r in kept.collect()}
    held: list[Matcher] = []

    def pairs(t: str) -> set[str]:
        out = set()
        if not held:
            held.append(Matcher(weights, []))
        for s in held[0].words(t):
            e = t.index(" ", s + 1)
            if s:
                out.add(t[t.rindex(" ", 0, s) + 1:e])
            if e < len(t) - 1:
                out.add(t[s + 1:t.index(" ", e + 1)])
        return out

    spared = [r["entry"] for r in _totals(distinct, pairs).where((F.col("pos") == 0) & (F.col("neg") >= MIN_DOCS))
              .orderBy(F.desc("neg"), "entry").limit(entries).collect()] if weights else []
    spared = list(dict.fromkeys([*exceptions, *spared]))
    got = distinct.select("text", "toxic").mapInArrow(_values(weights, spared), "x double, y int").toPandas()
    slope, offset = _logistic(got["x"].to_numpy(), got["y"].to_numpy(float))
    return {"weights": weights, "exceptions": spared, "slope": slope, "offset": offset}


def _values(weights: dict[str, float], spared: list[str]):
    """(text, toxic) -> (value, toxic).  Automata are made in the task; only the lists are sent."""
    def run(batches):
        match = Matcher(weights, spared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([match.value(folded(t)) for t in b.column(0).to_pylist()], pa.float64()),
                                              b.column(1)], ["x", "y"])
    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` plus _hgl_score, one row per row."""
    common.ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if not (drop_text and k == at)]
    out = T.StructType([docs.schema[k] for k in kept] + [T.StructField("_hgl_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(model["weights"], model["exceptions"])
        for b in batches:
            x = np.array([match.value(folded(t)) for t in b.column(at).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(s)], names=out.names)
    return docs.mapInArrow(run, out)
