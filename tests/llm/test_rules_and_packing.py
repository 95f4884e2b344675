"""Operators 1, 4 and 6 against DuckDB SQL and brute force."""
import random
import zlib
from array import array
from collections import defaultdict

import duckdb
import pytest

from hourglass.llm import decontaminate, host_quality, packing, queries
from hourglass.llm import common

SF001 = "/root/testdata/sf0.001"


def same_as_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if sf_dir.startswith('/tmp') else ''}')")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Odd rows: nulls, empty and long texts, repeated rows, short items, clashing columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    item = "alpha beta gamma delta éps zeta eta theta iota kappa lambda mu"
    docs = [(1, None, "a", 1), (2, "", "a", 1), (3, f"Xx {item.upper().replace('É', 'é')} yy", "b", 1), (3, f"{item} {item}", None, 1),
            (None, "Short Item! here", "c", 1), (4, "w " * 3000, "b", 1), (5, "l\n" * 60 + "#$% & x\n\n l ", "b", 1),
            (6, "tea for two", "c", 1), (6, "tea for two", "c", 1), (7, "a b　c " * 30, "hostx", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_words int").write.parquet(f"{d}/documents.parquet")
    items = [(1, item), (2, "short item"), (None, "tea for two"), (3, None), (4, "?!"), (5, "delta éps zeta eta theta iota kappa lambda mu nu xi"),
             (6, "short item")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for t in ("pages", "conversations"):
        spark.range(1).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_host_quality"])
def test_equal_to_sql(spark, odd_dir, name):
    same_as_sql(spark, name, odd_dir)
    same_as_sql(spark, name, SF001)


def test_large_benchmark_is_joined_by_hash(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    same_as_sql(spark, "op1_decontaminate", odd_dir)
    same_as_sql(spark, "op1_decontaminate", SF001)


def test_removal_of_spans_and_documents(spark, odd_dir):
    docs, bench = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    left = decontaminate.remove(docs, bench)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "5", "7"] and left.columns == docs.columns
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.remove(docs, bench, spans=True).collect()}
    assert (None, "! here") in cut and (3, "Xx yy") in cut and (4, "w " * 3000) in cut
    assert decontaminate.remove(docs.limit(0), bench).count() == 0
    assert decontaminate.remove(docs, bench.limit(0)).count() == docs.count()


def test_host_verdicts_shrink_small_hosts(spark):
    good = " ".join(f"wd{i}x" for i in range(60))
    rows = [(i, f"{good} {i}" if i % 10 else "x", "big") for i in range(300)]
    rows += [(1000 + i, "bad", "spam") for i in range(40)] + [(2000, " ".join(f"ok{i}x" for i in range(60)), "spam"), (3000, "y", "new")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    hosts = {r["host"]: r for r in host_quality.host_verdicts(host_quality.facts(df)).collect()}
    assert hosts["big"]["host_kept"] and not hosts["spam"]["host_kept"] and hosts["new"]["rate_few_words"] < 1
    kept = {r["doc_id"] for r in host_quality.judge(df).where("_hgl_kept").collect()}
    assert 2000 not in kept and 0 not in kept and 1 in kept
    assert host_quality.judge(df.limit(0)).count() == 0


ODD = [None, "", " ", "Hello, World! It's 42% <|endoftext|> done", "ÅÉñ ß ﬁ İstanbul ΣΑΣ naïve", "日本語 text wide", "\x1c\x85 a b",
       "don't WE'LL", "é combining", "x" * 30000, "a b\tc\r\nd" * 4000]


def check_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    want = defaultdict(list)
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += [(p, s, len(ids[s:s + 4096]), zlib.crc32(array("I", ids[s:s + 4096]).tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(n for b in bins.values() for _, n in b)
    return len(bins), -(-total // 4096)


def test_packing_round_trip(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "q")]
    assert check_packing(spark, docs)[0] >= 1
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    n, least = check_packing(spark, given)
    assert n <= least + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_fullest_is_optimal():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        room = r.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= counts[n] for n, k in used.items())


def test_plan_places_every_piece_once():
    import numpy as np
    r = random.Random(4)
    hist = {n: r.randint(1, 400) for n in r.sample(range(1, 2000), 300)}
    table, bins = packing.plan(hist)
    total = sum(hist.values())
    at = np.searchsorted(table[:, 0], np.arange(total), side="right") - 1
    bin_of = table[at, 1] + np.arange(total) - table[at, 0]
    lengths = np.repeat(sorted(hist), [hist[n] for n in sorted(hist)])
    assert np.bincount(bin_of, lengths).max() <= 4096 and bins == len(set(bin_of.tolist()))
    tokens = int(lengths.sum())
    assert bins <= -(-tokens // 4096) * 1.01 + 1


def test_keyed_orders_repeated_ids(spark):
    df = spark.createDataFrame([(2, "b"), (None, "z"), (2, "a"), (1, "c")], "doc_id bigint, text string")
    assert [r["text"] for r in common.with_key(df, "doc_id", "text").orderBy("_hgl_key").collect()] == ["c", "a", "b", "z"]
