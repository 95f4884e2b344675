"""Operator 2: unigram token counts with a trie of pre-tokens.

A pre-token is a run of characters other than \\x20 and \\x09-\\x0D, with the word mark
in front.  Its token count is that of its best segmentation into vocabulary pieces
(greatest sum of log probabilities, then fewest tokens).  The best score at a place depends
only on the prefix up to it, so distinct pre-tokens share a trie: each node, made once,
holds its prefix's forward score and token count, and a pre-token's end node
stores its count.  Documents add up the counts of their pre-tokens.  The new pre-tokens of
some documents are stored in order, so that each goes on from the node where it parts from the one before.

The trie lives in a task and is emptied at MAX_NODES, so memory is bounded, nothing
is shuffled, and no count depends on what else the task has seen.

The public vocabulary has no probabilities; its order is by rank, so a piece of rank
r gets Zipf's log probability, log(1 / (r + RANK_SHIFT)).  A character outside the
vocabulary counts one token a UTF-8 byte, at BYTE_SCORE each.

Null and empty texts: no pre-tokens, no tokens.  A very long pre-token is walked without
being stored.  Rows stay one for one: repeated rows, null ids and other
columns pass through (results are named ``_hgl_*``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
RANK_SHIFT = 10
BYTE_SCORE = -14.0
MAX_NODES = 1_000_000
LONG = 256                 # characters (with the mark) of the longest pre-token that is stored
TOGETHER = 4 << 20         # characters of texts whose new pre-tokens are stored together


def load_scores(path: str | None = None) -> dict[str, float]:
    """piece -> log probability, from the vocabulary's order."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [sp.id_to_piece(i) for i in range(sp.vocab_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(whole))))
    return {p: -math.log(r + RANK_SHIFT) - total for r, p in enumerate(whole)}


class Trie:
    """Prefix tree of pre-tokens with forward scores."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.max_nodes = max_nodes
        #: every end of a piece, with its score if it is a piece itself
        self.tails: dict[str, float | None] = {p[k:]: None for p in scores for k in range(len(p))} | scores
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.count: dict[str, int] = {}

    def forward(self, word: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of word[:end] from those of its prefixes."""
        get = self.tails.get
        top, n = get(word[end - 1]), 1
        if top is None:
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top = BYTE_SCORE * n
        top += best[end - 1]
        n += tokens[end - 1]
        for start in range(end - 2, -1, -1):
            s = get(word[start:end], False)
            if s is False:                               # no piece that starts here or earlier ends here
                break
            if s is not None:
                s += best[start]
                if s > top or s == top and tokens[start] + 1 < n:
                    top, n = s, tokens[start] + 1
        return top, n

    def add(self, words: Iterable[str]) -> None:
        """Stores the token counts of pre-tokens (without marks).  Taken in order, each goes on from where it
        parts from the one before."""
        child, last = self.child, ""
        path, best, tokens = [0], [0.0], [0]
        for plain in sorted(words):
            word, d = MARK + plain, 0
            for x, y in zip(last, word):
                if x != y:
                    break
                d += 1
            del path[d + 1:], best[d + 1:], tokens[d + 1:]
            node = path[d]
            for d in range(d + 1, len(word) + 1):
                edge = node * 0x110000 + ord(word[d - 1])
                node = child.get(edge)
                if node is None:
                    node = child[edge] = len(self.best)
                    s, t = self.forward(word, d, best, tokens)
                    self.best.append(s)
                    self.tokens.append(t)
                path.append(node)
                best.append(self.best[node])
                tokens.append(self.tokens[node])
            self.count[plain] = tokens[-1]
            last = word

    def walk(self, word: str) -> int:
        """Token count of a pre-token (with its mark), not stored."""
        best, tokens = [0.0], [0]
        for d in range(1, len(word) + 1):
            s, t = self.forward(word, d, best, tokens)
            best.append(s)
            tokens.append(t)
        return tokens[-1]

    def totals(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each text's pre-tokens (without marks)."""
        if len(self.best) > self.max_nodes:
            self.clear()
        known = self.count
        new = {w for words in texts for w in words if w not in known}
        long = {w: self.walk(MARK + w) for w in new if len(w) >= LONG}
        self.add(new.difference(long))
        known.update(long)
        out = [sum(map(known.__getitem__, words)) for words in texts]
        for w in long:
            del known[w]
        return out

    def total(self, words: list[str]) -> int:
        """Tokens of one text's pre-tokens (without marks)."""
        return self.totals([words])[0]


_LOADED: dict[str | None, Trie] = {}


def pre_tokens(t: str) -> list[str]:
    for space in "\t\n\x0b\x0c\r":
        t = t.replace(space, " ")
    return [w for w in t.split(" ") if w]


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None, drop_text: bool = False) -> DataFrame:
    """``docs`` plus _hgl_pretokens and _hgl_tokens."""
    common.ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if not (drop_text and k == at)]
    out = T.StructType([docs.schema[k] for k in kept] + [T.StructField(f"_hgl_{c}", T.LongType()) for c in ("pretokens", "tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _LOADED:
            _LOADED[vocabulary_path] = Trie(load_scores(vocabulary_path))
        trie = _LOADED[vocabulary_path]
        for b in batches:
            n, tokens, held, size = [], [], [], 0
            texts = b.column(at).to_pylist()
            for k, t in enumerate(texts, 1):
                held.append(pre_tokens(t or ""))
                size += len(t or "")
                if size >= TOGETHER or k == len(texts):
                    n += map(len, held)
                    tokens += trie.totals(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(n, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=out.names)
    return docs.mapInArrow(run, out)
