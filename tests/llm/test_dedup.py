"""Operators 3 and 9 against brute force."""
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hourglass.llm import near_dedup, suffix_dedup

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, n_removed string, key int"


def brute_repeats(rows, length=100):
    """rows: [(order, text)] -> {order: (n, removed, spans, sha)}"""
    seen, out = set(), {}
    for key, t in sorted(rows):
        raw = (t or "").encode()
        gone, new = bytearray(len(raw)), []
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\x01" * length
            else:
                seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def made_rows(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(6)]
    rows = [(None if i == 7 else i, None) if i % 40 == 39 else (i, "") if i % 40 == 38 else None for i in range(n)]
    for i in range(n):
        if rows[i] is None:
            parts = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(3)]
            parts.insert(r.randint(0, 3), r.choice(passages))
            if r.random() < 0.3:
                p = r.choice(passages)
                k = r.randint(0, len(p) // 3)
                parts.insert(r.randint(0, 3), p[k:k + r.randint(90, 220)])
            rows[i] = (i, " ".join(parts))
    rows.append((n, "ab" * 900))                        # a repeat inside one text
    rows.append((n + 1, rows[5][1]))                    # an exact copy
    rows.append((n + 2, "x" * 5000 + passages[0]))
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = made_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    out = suffix_dedup.cut_repeats(df)
    assert out.columns[:4] == ["doc_id", "text", "n_removed", "key"]
    got = {r["doc_id"]: tuple(r[f"_hgl_{c}"] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect()}
    want = brute_repeats([(i, t) for i, t in rows])
    assert got == want


def test_repeats_on_long_texts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rows = [(None, made_rows(5, 20)[3][1]), (1, "z" * 3000), (1, "z" * 3000), (None, None), (2, made_rows(5, 20)[3][1] + "é" * 80)]
    got = [tuple(r) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
           .select("doc_id", "_hgl_n_bytes", "_hgl_n_removed", "_hgl_n_spans", "_hgl_kept_sha256").collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(order)])
    assert sorted(got, key=str) == sorted(((order[k][0], *v) for k, v in want.items()), key=str)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_repeat_text_keeps_whole_characters(spark):
    p = "é" * 60
    df = spark.createDataFrame([(1, p), (2, "é" + p[:-1] + "a" + p)], "doc_id int, text string")
    for r in suffix_dedup.cut_repeats(df).collect():
        r["_hgl_kept_text"].encode()


def test_maximal_repeats_list_all_occurrences(spark):
    r = random.Random(1)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = rnd(130)
    rows = [(i, rnd(150) + p + rnd(150)) for i in range(4)]
    got = suffix_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id int, text string"))
    texts = dict(rows)
    found = defaultdict(list)
    for x in got.collect():
        found[(x["repeat"], x["n"], texts[x["_hgl_key"]].encode()[x["lo"]:x["lo"] + x["n"]])].append(x["_hgl_key"])
    assert any(sorted(v) == [0, 1, 2, 3] and k[2] in p.encode() for k, v in found.items())


def brute_maximal(texts, length=100):
    """{piece: all its places} of the pieces that two runs of an anchor share around it, by plain search."""
    import numpy as np
    runs, out = defaultdict(list), {}
    for key, raw in texts.items():
        d = np.frombuffer(raw, np.uint8)
        _, lo, hi, place, a = suffix_dedup.anchor_runs(d, np.array([0]), np.array([len(d)]), length)
        for x, y, p, h in zip(lo.tolist(), hi.tolist(), place.tolist(), a.tolist()):
            runs[h].append((raw[x:p][::-1], raw[p:y + length]))
    shared = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for group in runs.values():
        for i, (l1, r1) in enumerate(group):
            for l2, r2 in group[:i]:
                n, m = shared(l1, l2), shared(r1, r2)
                if n + m >= length:
                    out[l1[:n][::-1] + r1[:m]] = set()
    for w, places in out.items():
        for key, raw in texts.items():
            at = raw.find(w)
            while at >= 0:
                places.add((key, at))
                at = raw.find(w, at + 1)
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_maximal_repeats_equal_brute_force(spark, monkeypatch, hot):
    """Exact copies, copies of a long passage with different neighbours, and (hot=2) anchors over HOT."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(2)
    rnd = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    long, short, copy = rnd(900), rnd(130), rnd(400)
    rows = [(i, rnd(150) + long + rnd(150)) for i in range(4)] + [(i, rnd(80) + short[r.randint(0, 20):] + rnd(80)) for i in range(4, 12)]
    rows += [(12, copy), (13, copy), (14, copy), (15, None), (16, ""), (17, rnd(300)), (18, copy[:150]), (19, rows[5][1])]
    rows += [(20, "x" * 300)]
    got = defaultdict(list)
    for x in suffix_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect():
        got[x["repeat"]].append((x["n"], x["_hgl_key"], x["lo"]))
    texts = {k: (t or "").encode() for k, t in rows}
    found = {}
    for places in got.values():
        (piece,) = {texts[k][lo:lo + n] for n, k, lo in places}          # one id, one string
        assert piece not in found and len(places) == len(set(places))
        found[piece] = {(k, lo) for _, k, lo in places}
    assert found == brute_maximal(texts)
    covered = {(k, i) for w, places in found.items() for k, lo in places for i in range(lo, lo + len(w) - 99)}
    seen = defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t) - 99):
            seen[t[i:i + 100]].add((k, i))
    assert covered == set().union(*(v for v in seen.values() if len(v) > 1))


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = defaultdict(set)
    for i, s in sets:
        for x in s:
            by[x].add(i)
    d = dict(sets)
    for i, s in sets:
        for j in {j for x in s for j in by[x] if j < i}:
            x = len(s & d[j])
            if 100 * x >= 75 * (len(s) + len(d[j]) - x):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def check_groups(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["_hgl_n"], r["_hgl_component"], r["_hgl_kept"]) for r in near_dedup.groups(df).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_groups_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    r = random.Random(11)
    vocab = ["w%d" % i for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(30, 200))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One two"), (4, "one TWO"), (5, "one two three four five")]
    for i in range(6, 150):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 1, 2, 3, 8))):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w).title() if i % 2 else " ".join(w)))
    check_groups(spark, rows)


def test_groups_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    check_groups(spark, rows)


def test_groups_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r["doc_id"]), str(r["_hgl_component"]), r["_hgl_kept"]) for r in got.collect()) == [
        ("1", "1", False), ("1", "1", True), ("None", "1", False), ("None", "None", True)]
    assert near_dedup.groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_loose_groups_equal_brute_force(spark):
    """Variants of one text, most of them under the limit to each other."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice((2, 4, 5, 6, 7, 9, 14))):
            w[r.randrange(len(w))] = f"c{r.randrange(8)}"
        rows.append((i, " ".join(w)))
    check_groups(spark, rows)


def test_sketch_fills_all_bins_and_estimates():
    import numpy as np
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    row = np.repeat([0, 1, 2], [2000, 2000, 1])
    s = near_dedup.sketch(row, np.concatenate([a, b, pool[:1]]), 3)
    assert (s != near_dedup._FULL).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
