"""corpus_pipeline against a brute-force version of its stages."""
import re
import zlib
from array import array

import duckdb
import pytest

import corpus_pipeline
from hourglass.llm import queries
from test_dedup import brute_groups

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def cut(rows, length=100):
    """Texts without whole characters of strings that start earlier."""
    seen, out = set(), []
    for key, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\x01" * length
            else:
                seen.add(w)
        if raw and all(gone):
            continue
        kept, at = [], 0
        for ch in raw.decode():
            n = len(ch.encode())
            if not all(gone[at:at + n]):
                kept.append(ch)
            at += n
        out.append((key, "".join(kept) if t is not None else None))
    return out


def windows(t, n=10):
    w = WORD.findall(lower(t))
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def contaminated(t, bench):
    w = WORD.findall(lower(t))
    return any(tuple(w[i:i + k]) in bench for k in {len(b) for b in bench} for i in range(len(w) - k + 1))


def brute(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rules = con.execute(queries.ORACLES["op4_host_quality"])
    at = [d[0] for d in rules.description]
    good = {r[at.index("doc_id")] for r in rules.fetchall() if r[at.index("kept")]}
    docs = [(i, t) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in good]
    groups = brute_groups(docs)
    docs = cut([(i, t) for i, t in docs if groups[i][2]])
    bench = set().union(*(windows(t) for t, in con.execute("SELECT text FROM benchmark").fetchall()))
    docs = [(i, t) for i, t in docs if not contaminated(t, bench)]
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(i, p, s, len(ids[s:s + 4096]), zlib.crc32(array("I", ids[s:s + 4096]).tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def test_run_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF001).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute(SF001)


ODD = [(1, None, "en", "a", None, 7), (2, "", "en", None, 0, 7), (None, "few words", None, "a", 9, 7), (3, "x " * 5000, "de", "b", 10000, 7)]
GOOD = [(10 + i, " ".join(f"w{i}x{j}" for j in range(80 + i)) + " é" * 3, "en", "b", 1, 7) for i in range(6)]


@pytest.mark.parametrize("rows", [[], ODD, ODD + GOOD + GOOD[:2]])
def test_stages_keep_the_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        got = {r["doc_id"] for r in out.collect()}
        assert {r[0] for r in rows if r in GOOD} <= got, name
        if name == "quality_rules":
            assert got == {r[0] for r in rows if r in GOOD}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({str(r[0]) for r in rows})


def test_pack_stage_returns_the_tokens(spark):
    from hourglass.llm import stages
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "word " * 5000), (3, None)], "doc_id bigint, text string")
    rows = stages.pack(spark, docs, SF001).collect()
    assert len(rows) > 3
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] for r in rows)
