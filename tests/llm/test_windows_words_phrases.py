"""Operators 11, 12 and 13 against brute force, with odd rows, and what their helpers promise."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import collocations, common, spelling, window_dedup

SCHEMA = "doc_id bigint, text string, lang string, n_removed string, key int"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], SCHEMA).repartition(parts)


# ---------------------------------------------------------------- operator 11

def brute_windows(rows, k=20):
    """rows: [(order, text)] -> {order: (n, removed, sha)}, and the count of each window."""
    seen, out = Counter(), {}
    for key, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = " ".join(w[i:i + k])
            if g in seen:
                gone[i:i + k] = [True] * k
            seen[g] += 1
        out[key] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out, {g: n for g, n in seen.items() if n > 1}


def passages(seed=7, n=90):
    r = random.Random(seed)
    words = lambda k: [r.choice("abcdeé") * r.randint(1, 3) + r.choice("xyz") for _ in range(k)]
    shared = [words(r.randint(15, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        if i % 30 in (28, 29):
            rows.append((None if i == 28 else i, None if i % 30 == 29 else " \t\n", "en"))
            continue
        parts = words(r.randint(0, 40)) + r.choice(shared) + words(r.randint(0, 40))
        if r.random() < 0.3:
            p = r.choice(shared)
            parts += p[r.randint(0, 10):]
        rows.append((i, r.choice([" ", "  ", "\n", " \t "]).join(parts), "en"))
    rows += [(n, rows[3][1], "en"), (n + 1, "one two " * 200, "en"), (n + 2, " ".join(shared[0] * 3), None)]
    return rows


@pytest.mark.parametrize("hot,segment,flush", [(4096, 1 << 20, 2 << 20), (2, 50, 200), (10 ** 9, 1 << 20, 1)])
def test_windows_equal_brute_force(spark, monkeypatch, hot, segment, flush):
    monkeypatch.setattr(window_dedup, "HOT", hot)
    monkeypatch.setattr(window_dedup, "SEGMENT", segment)
    monkeypatch.setattr(window_dedup, "FLUSH", flush)
    rows = passages()
    out = window_dedup.cut_windows(table(spark, rows))
    assert out.columns[:5] == ["doc_id", "text", "lang", "n_removed", "key"]
    got = {r["doc_id"]: (r["_hgl_n_words"], r["_hgl_n_removed"], r["_hgl_kept_sha256"]) for r in out.collect()}
    want, counts = brute_windows([(i if i is not None else 10 ** 6, t) for i, t, _ in rows])
    want[None] = want.pop(10 ** 6)
    assert got == want
    assert {r["words"]: r["n"] for r in window_dedup.repeated_windows(table(spark, rows)).collect()} == counts


def test_windows_of_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(45))
    rows = [(1, t, "a"), (1, t, "a"), (None, t, None), (None, None, None), (2, "", None)]
    got = [(str(r["doc_id"]), r["_hgl_n_words"], r["_hgl_n_removed"], r["_hgl_kept_text"]) for r in
           window_dedup.cut_windows(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([("1", 45, 0, t), ("1", 45, 45, ""), ("None", 45, 45, ""), ("None", 0, 0, None), ("2", 0, 0, "")], key=str)
    assert window_dedup.cut_windows(table(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, t, 5, 6, 7), (2, t, 5, 6, 7)], "doc_id int, text string, m int, lo int, _hgl_text int")
    assert [r["_hgl_n_removed"] for r in window_dedup.cut_windows(clash).orderBy("doc_id").collect()] == [0, 45]


def test_equal_hashes_of_different_windows_are_told_apart(spark, monkeypatch):
    """With a hash that is always the same, only the words decide."""
    monkeypatch.setattr(window_dedup, "_sums", lambda h, k, coef: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    import pyarrow as pa
    rows = [(7, -1, key, 0, 2, " ".join(w).encode()) for key, w in ((1, "abcd"), (2, "abce"), (3, "xbce"))]
    t = pa.Table.from_pylist([dict(zip("mhksnw", r)) for r in rows])
    out = window_dedup._spans(window_dedup.Windows(t, 3)).to_pylist()
    assert sorted(tuple(r.values()) for r in out) == [(2, 0, 3, None, None), (3, 1, 4, None, None)]


# ---------------------------------------------------------------- operator 12

def brute_near(words):
    """{word: [near words]} by all pairs."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    return {a: [b for b in words if near(a, b)] for a in words}


def brute_variants(rows, every):
    total = Counter()
    for i, t, _ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    near = brute_near(n)
    form = {}
    for w in n:
        b = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = b if b is not None and n[b] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def spelled(seed=11):
    r = random.Random(seed)
    base = ["".join(r.choice("abcéÀ") for _ in range(r.randint(6, 9))) for _ in range(25)] + ["a" * 300, "abcabcabc"]
    pool = []
    for k, w in enumerate(base):
        pool += [w] * (2 + 4 ** (k % 5))
        for _ in range(8):
            i = r.randrange(len(w))
            v = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcd") + w[i + 1:], w[:i] + r.choice("abcd") + w[i:]])
            pool += [v] * r.choice([1, 5, 6, 30])
    r.shuffle(pool)
    rows = [(i, r.choice([" ", ", ", "4", "\n"]).join(pool[i::60]).replace("abc", "ABc"), None) for i in range(60)]
    return rows + [(5, None, None), (None, rows[0][1], "en"), (None, "", None), (6, rows[6][1], None)]


@pytest.mark.parametrize("block,tile,held", [(2048, 192, 400_000), (3, 5, 20)])
def test_variants_equal_brute_force(spark, monkeypatch, block, tile, held):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rows = spelled()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(table(spark, rows), every=7).collect()}
    want = brute_variants(rows, 7)
    assert len(want) > 100 and any(v[4] != w and v[2] != v[4] for w, v in want.items())
    assert got == want


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None, None), (2, "ab cd", None)])).count() == 0


def test_close_pairs_are_a_superset_of_near_words():
    words = sorted(brute_variants(spelled(), 7))
    x = spelling.letter_counts(words)
    n, one = len(words), np.zeros(len(words), int)
    pairs = set()
    for apart in (1, 2):
        i, j = spelling.close_pairs(x, one, one, one.astype(bool), np.full(n, apart))
        pairs |= set(zip(i.tolist(), j.tolist()))
    near = brute_near(words)
    assert {(i, j) for i in range(n) for j in range(i + 1, n) if words[j] in near[words[i]]} <= pairs
    assert all(spelling.one_edit(words[i], words[j]) == (words[j] in near[words[i]]) for i, j in pairs)


# ---------------------------------------------------------------- operator 13

def pieces(t):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_phrases(rows, least=10, limit=2000):
    f = defaultdict(Counter)
    for _, t, lang in rows:
        for w in pieces(t):
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        inside = defaultdict(int)
        for g, v in c.items():
            if len(g) == 3 and v >= least:
                for p in (g[:2], g[1:]):
                    inside[p] = max(inside[p], v)
        rank = []
        for g, a in c.items():
            if len(g) < 2 or a < least or (len(g) == 2 and g in inside and 100 * inside[g] >= 50 * a):
                continue
            s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rank.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:limit])]
    return sorted(out)


def spoken(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Der", "é", "l'a"]
    fixed = ["so it goes on and on every day", "New York City"]
    rows = []
    for i in range(160):
        t = "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((i, t + r.choice(fixed) + r.choice([". ", " ! ", " end"]) + ("x" if i % 3 else ""), r.choice(["en", "de", None, "und"])))
    return rows + [(None, None, "fr"), (1, "", "fr"), (2, " . ,", "fr"), (1, rows[1][1], "en")]


@pytest.mark.parametrize("block,limit", [(6 << 20, 2000), (300, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, block, limit):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = spoken()
    out = collocations.collocations(table(spark, rows), limit=limit)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect())
    want = brute_phrases(rows, limit=limit)
    assert len(want) > 20 and got == want
    assert collocations.collocations(table(spark, [])).count() == 0


def test_paths_are_the_edges_along_unary_nodes(spark):
    rows = spoken()
    edges, nodes, _ = collocations.graph(table(spark, rows), least=1)
    got = sorted((r["lang"], r["phrase"], r["n"]) for r in collocations.paths(edges, nodes).collect())
    n, flow = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        for w in pieces(t):
            for i in range(len(w) - 1):
                flow[lang or "und"][tuple(w[i:i + 2])] += 1
            for i in range(len(w) - 2):
                n[lang or "und"][tuple(w[i:i + 3])] += 1
    want = []
    for lang, c in n.items():
        def step(v, place):
            """The edge that carries all of node v's flow, on one side."""
            return next((e for e, k in c.items() if (e[:2] if place else e[1:]) == v and k == flow[lang][v]), None)
        for e, k in c.items():
            if step(e[:2], 0) and step(e[:2], 1):
                continue                                    # goes on from another edge
            words = list(e)
            while (nxt := step(tuple(words[-2:]), 1)) and step(tuple(words[-2:]), 0):
                words.append(nxt[2])
            want.append((lang, " ".join(words), k))
    assert got == sorted(want) and any(len(p.split()) > 5 for _, p, _ in got)


def test_scores_pass_64_bits(spark):
    """floor(10^6 a a / (l r)) with products over 2^63."""
    df = spark.createDataFrame([(3 * 10 ** 12, 4 * 10 ** 12, 5 * 10 ** 12)], "a bigint, l bigint, r bigint")
    wide = [F.col(c).cast("decimal(16,0)") for c in "alr"]
    got = df.select(F.call_function("div", wide[0] * wide[0] * F.lit(1000000).cast("decimal(7,0)"), wide[1] * wide[2])).first()[0]
    assert got == 1000000 * 9 * 10 ** 24 // (20 * 10 ** 24)


def test_saved_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, conf = files(), spark.conf.get(name, None)
    rows = spark.range(50_000).groupBy((F.col("id") % 7000).alias("m")).count()
    out = common.save(rows.join(rows.withColumnRenamed("count", "c"), "m").repartition(5, "c", "m"), "tidy")
    until = time.time() + 10
    while files() - was and time.time() < until:      # they go shortly after the write
        time.sleep(0.2)
    assert not files() - was
    assert out.count() == 7000 and spark.conf.get(name, None) == conf
