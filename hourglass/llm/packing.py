"""Operator 6: best-fit packing of token sequences by minimum bin slack.

1. ``pieces``: texts become ids of a public tokenizer, one end id is added, and documents
   over the capacity are cut.  One small row a piece.
2. The plan needs only how many pieces there are of each length (at most CAPACITY
   counts, so the driver can hold them).  ``plan``: a bin takes the longest length
   left; a bitset subset-sum over the lengths left finds the fullest feasible rest; the
   combination is removed, as often as its lengths last.  Each combination uses
   up a length or nearly so, which bounds the plan by the lengths, not by the rows.
3. Pieces are numbered in the order (length, document, piece) without a
   single-task window (``with_row_index``); the number names the bin and the place.

Tokens of a word don't depend on its neighbours in this tokenizer, so they are
looked up by word; only new words go to the library.  Texts with
characters for which that isn't certain go to it whole.

Null and empty texts: the end id alone.  Repeated rows, null or repeated ids: each row is
packed.  Other columns aren't read.  Empty table: no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.order import with_row_index
from . import common, text
from .common import KEY

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 400_000

#: Characters whose normal form, lower case and class are the same for this tokenizer and Python; and its special tokens' start.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-įı-ɏ]*")
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    ones for themselves, the others from 256 on in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Ids of texts as little-endian 32-bit bytes, with a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a Spark task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Ids of new words.  A word of letters is one piece for the model; a sign after it is
        another; anything else goes through the whole tokenizer."""
        known, tokenize, letters, rest = self.known, self.model.tokenize, self.letters, []
        for w in new:
            base = w[:-1] if w[-1] in ".," else w
            if not base.isalpha():
                rest.append(w)
                continue
            ids = known.get(base)
            if ids is None:
                piece = base if base.isascii() else base.encode().decode("latin-1").translate(letters)
                ids = known[base] = array("I", [t.id for t in tokenize(piece)]).tobytes()
            if base is not w:
                known[w] = ids + self.signs[w[-1]]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()

    @cached_property
    def signs(self) -> dict[str, bytes]:
        return {c: array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.lower().split() if _PLAIN.fullmatch(t) and _SPECIAL not in t else None for t in texts]
        seen: set[str] = set()
        for w in split:
            if w:
                seen.update(w)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        self.learn([w for w in seen if w not in known])
        return [b"".join(map(known.__getitem__, w)) if w is not None else
                array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for w, t in zip(split, texts)]


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str | None) -> WordTokens:
    """The worker's tokenizer; ``path`` None: the installed public file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def _cut(path: str | None, capacity: int, keep_ids: bool, id_type: pa.DataType):
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, who = np.asarray(b.column(0)), b.column(2).cast(id_type)
            _, o = text.utf8(b.column(1))
            for i, j in text.chunks(o):                     # few texts' ids at a time, however long the batch
                rows, parts = [], []
                for k, ids in enumerate(_tokens(path).encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        part = ids[4 * s:4 * (s + capacity)]
                        rows.append((i + k, p, s, len(part) // 4, zlib.crc32(part)))
                        if keep_ids:
                            parts.append(part)
                row, *cols = zip(*rows)
                row = np.array(row)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                out = [pa.array(key[row]), who.take(pa.array(row))] + [pa.array(list(c), t) for c, t in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(parts, pa.binary())] * keep_ids,
                                                 [KEY, "_hgl_id", "piece", "start", "length", "ids_crc32", "ids"][:6 + keep_ids])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """(KEY, _hgl_id, piece, start, length, ids_crc32[, ids]) of ``docs`` with KEY; ids as little-endian 32-bit bytes."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(KEY, T.LongType()), T.StructField("_hgl_id", kind), T.StructField("piece", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
                          + [T.StructField("ids", T.BinaryType())] * keep_ids)
    return docs.select(KEY, text_col, id_col).mapInArrow(_cut(tokenizer_path, capacity, keep_ids, to_arrow_type(kind)), schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> Counter:
    """The combination of ``counts`` with the greatest sum up to ``room``
    (``lengths``: its keys, descending), by a bitset over sums."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left:                                  # 1, 2, 4, ... of this length
            take = min(take, left)
            steps.append((n, take, bits))
            bits |= (bits << (n * take)) & mask
            left -= take
            take *= 2
        if bits >> room:
            break
    total, used = bits.bit_length() - 1, Counter()
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] += take
            total -= n * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """((first number, first bin, place) rows sorted by first number, bins).
    Numbers follow (length, ...); a row's numbers go to as many bins in turn."""
    counts = {n: c for n, c in histogram.items() if c}
    order = sorted(counts)
    begin = dict(zip(order, np.cumsum([0] + [counts[n] for n in order]).tolist()))
    rows, bins = [], 0
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        lengths = [n for n in sorted(rest, reverse=True) if rest[n]]
        used = fullest(rest, lengths, capacity - longest)
        used[longest] += 1
        times = min(counts[n] // k for n, k in used.items())
        place = 0
        for n, k in used.items():
            for _ in range(k):
                rows.append((begin[n], bins, place))
                begin[n] += times
                place += n
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3), bins


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bins, places = table.value.T
        for b in batches:
            number = np.asarray(b.column(b.num_columns - 1))
            at = np.searchsorted(first, number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                list(b.columns[:-1]) + [pa.array(bins[at] + number - first[at]), pa.array(places[at])],
                names=b.schema.names[:-1] + ["sequence_id", "offset"])
    return run


def _as_ints(at: int):
    """The binary column ``at`` as lists of ints, without a copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.concat_arrays([b.column(at)])
            _, offs, data = raw.buffers()
            offsets = np.frombuffer(offs, np.int32)[raw.offset:raw.offset + len(raw) + 1] // 4
            ints = pa.Array.from_buffers(pa.int32(), (data.size if data else 0) // 4, [None, data or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), ints) if k == at else c for k, c in enumerate(b.columns)],
                                             b.schema.names)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row a piece: the id, piece, start, length, ids_crc32[, ids], sequence_id, offset.  Only
    a small row a piece is numbered and placed; the ids are joined to their place once, at the end."""
    spark = docs.sparkSession
    common.ready(spark)
    keyed = common.with_key(docs.select(id_col, text_col), id_col, text_col)
    cut = common.save(pieces(keyed, id_col, text_col, tokenizer_path, capacity, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}   # at most ``capacity`` rows
    table, _ = plan(histogram, capacity)
    own = [KEY, "piece"] if keep_ids else [c for c in cut.columns if c != "length"]
    numbered = with_row_index(cut.select("length", *own), ["length", KEY, "piece"], index_col="_hgl_number").select("length", *own, "_hgl_number")
    kind = numbered.drop("_hgl_number").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    out = numbered.mapInArrow(_place(spark.sparkContext.broadcast(table)), kind)
    if keep_ids:
        out = cut.join(out.drop("length"), [KEY, "piece"])
    names = ["_hgl_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    out = out.select(*names)
    if keep_ids:
        ints = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in out.schema])
        out = out.mapInArrow(_as_ints(names.index("ids")), ints)
    return out.withColumnRenamed("_hgl_id", id_col)
