"""Operator 8: language identification in two levels.

A first set of linear support vector machines (one against the rest) picks the
language family; within it, machines for each pair of its languages vote (ties go to
the greater sum of margins).  Features are the frequencies of hashed three-byte
sequences of the whole text, letters lower-cased, other ASCII as space.

Training takes about PER_LANG rows a language (by a hash of the id), whole texts;
only their feature vectors (BUCKETS numbers) reach the driver, where each machine is
fitted by dual coordinate descent.  Prediction is one pass over all rows without a shuffle.

A language of no listed family is a family of its own.  Null text or text without a letter: ``und``, score
0.  Empty training set: ``und`` for all.  Rows stay one for one; repeated rows and null
ids are predicted like others; other columns pass through (results are ``_hgl_*``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text

BUCKETS = 4096
PER_LANG = 400
EPOCHS = 60
COST = 10.0
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
U = np.uint64

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_GRAM = (text.mix(np.arange(155 ** 3, dtype=U) + U(1)) % U(BUCKETS)).astype(np.int64)


def features(data: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Frequencies (rows x BUCKETS) of rows given as bytes and offsets."""
    m = len(o) - 1
    if len(data) < 3:
        return np.zeros((m, BUCKETS), np.float32)
    c = _CLASS[data]
    gram = _GRAM[(c[:-2] * 155 + c[1:-1]) * 155 + c[2:]]
    row = np.repeat(np.arange(m), np.diff(o))
    ok = (row[:-2] == row[2:]) & (c[:-2] + c[1:-1] + c[2:] > 0)
    n = np.bincount(row[:-2][ok] * BUCKETS + gram[ok], minlength=m * BUCKETS).reshape(m, BUCKETS).astype(np.float32)
    return n / np.maximum(n.sum(1, keepdims=True), 1)


def _parts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    d, o = text.utf8(col)
    for i, j in text.chunks(o):
        for x in range(i, j, 256):
            y = min(x + 256, j)
            yield x, y, features(d[o[x]:o[y]], o[x:y + 1] - o[x])


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (last: offset) of a linear support vector machine, y in (-1, 1)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Machines by family and by pair of languages in a family."""
    scale = 1 / max(float(np.sqrt((x * x).sum(1)).mean()), 1e-9) if len(x) else 1.0
    x = (x * scale).astype(np.float64)
    lang = np.array(langs)
    names = sorted(set(langs))
    family = {n: _FAMILY.get(n, n) for n in names}
    kinds = sorted(set(family.values()))
    of = np.array([family[n] for n in langs])
    rows = []
    if len(kinds) > 1:
        for k in kinds[:1] if len(kinds) == 2 else kinds:
            rows.append(machine(x, np.where(of == k, 1.0, -1.0)))
        if len(kinds) == 2:
            rows.append(-rows[0])
    else:
        rows.append(np.zeros(x.shape[1] + 1) if len(x) else np.zeros(BUCKETS + 1))
    pairs = [(a, b) for a, b in combinations(range(len(names)), 2) if family[names[a]] == family[names[b]]]
    for a, b in pairs:
        own = (lang == names[a]) | (lang == names[b])
        rows.append(machine(x[own], np.where(lang[own] == names[a], 1.0, -1.0)))
    w = np.array(rows)
    return {"names": names, "kinds": kinds, "family": [kinds.index(family[n]) for n in names], "pairs": pairs,
            "w": (w[:, :-1] * scale).astype(np.float32), "b": w[:, -1]}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into names, score 0 to 1) of feature rows."""
    m = x @ model["w"].T + model["b"]
    first = m[:, :len(model["kinds"])]
    kind = first.argmax(1)
    votes, margins = np.zeros((len(x), len(model["names"]))), np.zeros((len(x), len(model["names"])))
    for k, (a, b) in enumerate(model["pairs"], len(model["kinds"])):
        won = m[:, k] > 0
        votes[:, a] += won
        votes[:, b] += ~won
        margins[:, a] += m[:, k]
        margins[:, b] -= m[:, k]
    inside = np.array(model["family"])[None, :] == kind[:, None]
    rank = np.where(inside, votes + 0.5 / (1 + np.exp(-np.clip(margins, -30, 30))), -1)
    best = rank.argmax(1)
    at = np.arange(len(x))
    rivals = np.maximum(np.array(model["family"])[None, :] == np.array(model["family"])[:, None], 0).sum(1) - 1
    own = np.where(rivals[best] > 0, margins[at, best] / np.maximum(rivals[best], 1), 30.0)
    up = first[at, kind] if len(model["kinds"]) > 1 else np.full(len(x), 30.0)
    sure = 1 / ((1 + np.exp(-np.clip(2 * own, -30, 30))) * (1 + np.exp(-np.clip(2 * up, -30, 30))))
    return best, sure


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> dict:
    """The model from rows with text and language; the caller chooses which rows may be learned from."""
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    n = rows.groupBy("lang").count()
    share = n.select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count")).alias("share"))
    chosen = (rows.join(F.broadcast(share), "lang")           # a row a language
              .where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < 1_000_000 * F.col("share")).select("lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in _parts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(run, "lang string, x binary").collect())
    x = np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, BUCKETS)
    return train(x, [k for k, _ in got])


def identify(docs: DataFrame, model: dict, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` plus _hgl_lang and _hgl_score."""
    common.ready(docs.sparkSession)
    flagged = docs.withColumn("_hgl_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if not (drop_text and k == at)]
    out = T.StructType([docs.schema[k] for k in kept] + [T.StructField("_hgl_lang", T.StringType()), T.StructField("_hgl_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model["names"] + [UNKNOWN], object)
        for b in batches:
            best, sure = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            if model["names"]:
                for i, j, x in _parts(b.column(at)):
                    best[i:j], sure[i:j] = predict(model, x)
            letter = np.asarray(b.column(b.num_columns - 1).to_pylist(), bool)
            best, sure = np.where(letter, best, len(names) - 1), np.where(letter, sure, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(names[best].tolist(), pa.string()), pa.array(sure.astype(float))],
                                             names=out.names)
    return flagged.mapInArrow(run, out)
