"""Runs, the filter audit and the pivot index against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetloom.llm import registry, sql
from assetloom.llm.audit import op12_filter_audit, transpositions, walk
from assetloom.llm.periods import _ordered, op13_periodic_runs, periodic, with_runs
from assetloom.llm.pivots import chosen, near_vectors, op11_pivot_near_dup, permutation, pivot_number, units

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs ----


def brute_runs(w, least):
    """Every maximal stretch of every period, by walking along it; of equal stretches the smallest period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                out.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((i, j - i, p) for (i, j), p in out.items())


def by_start_then_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_equal_brute_force(sequences, least):
    flat = np.array([x for s in sequences for x in s], dtype=np.int64)
    starts = np.cumsum([0] + [len(s) for s in sequences])[:-1]
    keep = [k for k, s in enumerate(sequences) if s]
    got = _ordered(periodic(flat, starts[keep], least)).tolist()
    want = [r for k, s in enumerate(sequences) for r in by_start_then_period([(i + starts[k], n, p) for i, n, p in brute_runs(s, least)])]
    assert [(i, j - i, p) for i, j, p in got] == want


def test_runs_of_periodic_and_nested_sequences():
    r = random.Random(3)
    for t in range(300):
        w = [r.randrange(3) for _ in range(r.randrange(20, 120))]
        a = r.randrange(len(w))
        p = 1 + r.randrange(max(1, (len(w) - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))] + w[: r.randrange(len(w))] * r.randrange(3)
        got = [(i, j - i, q) for i, j, q in _ordered(periodic(np.array(w), np.array([0]), 12)).tolist()]
        assert got == by_start_then_period(brute_runs(w, 12)), t
    for w in ([0] * 5000, list(range(7)) * 800, sum(([k] * 9 for k in range(400)), [])):
        assert [(i, j - i, q) for i, j, q in periodic(np.array(w), np.array([0])).tolist()] == ([(0, len(w), len(set(w)))] if len(set(w)) < 8 else [])


def contract(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = by_start_then_period(brute_runs(w, 12))
    gone = {k for i, n, p in runs for k in range(i + p, i + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{i},{n},{p}\n" for i, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op13_equals_brute_force(spark, docs_of, odd_rows):
    r = random.Random(9)
    rows = [x for x in odd_rows if len(x[1] or "") < 100_000]
    rows += [(5000 + i, " ".join(r.choice("ab" if i % 2 else "abcdefgh") for _ in range(r.randrange(400))), "en", "s") for i in range(150)]
    rows += [(6000, "a\x0bb\x85c " * 30, "en", "s"), (6001, "Alpha beta x\n" * 20, None, None), (None, "one two " * 20, "en", "s")]
    got = op13_periodic_runs(spark, docs_of(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(contract(d, t)) for d, t, _, _ in rows)
    assert sum(x["n_runs"] for x in got) > 100


def test_runs_keep_columns_and_very_long_texts(spark, docs_of):
    names = ("doc_id", "n_words", "runs", "collapsed", "c0", "start", "w", "g")
    df = docs_of([(1, "x y " * 100_000 + "z", "en", "s"), (2, None, "en", "s"), (3, "q" * 300_000, None, None)]).selectExpr("doc_id", "text", *[f"7 as `{c}`" for c in names[1:]])
    got = {r["doc_id"]: r for r in with_runs(spark, df).collect()}
    assert [(tuple(x) for x in got[1]["runs"]).__next__(), got[1]["collapsed"], got[1]["n_words"]] == [(0, 200_000, 2), "x y z", 200_001]
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[3]["collapsed"] == "q" * 300_000 and got[3]["c0"] == 7 == got[3]["g"]
    assert op13_periodic_runs(spark, df).count() == 3
    empty = docs_of([])
    assert with_runs(spark, empty).collect() == [] == op13_periodic_runs(spark, empty).collect()


# ---- filter audit ----


def test_every_order_once_by_single_swaps():
    for n in range(1, 7):
        seen = [(tuple(o), c) for o, c in transpositions(n)]
        assert sorted(o for o, _ in seen) == sorted(itertools.permutations(range(n)))
        for (a, _), (b, c) in itertools.pairwise(seen):
            assert a[c] == b[c + 1] and a[c + 1] == b[c] and a[:c] == b[:c] and a[c + 2 :] == b[c + 2 :]


def test_walk_equals_recounting():
    cells = np.random.default_rng(4).integers(0, 50, (16, 2))
    orders, removed, shapley = walk(cells, 4)
    again = np.zeros(4, np.int64)
    for o, got in zip(orders, removed, strict=True):
        left = dict(enumerate(cells.tolist()))
        for k, f in enumerate(o):
            out = [m for m in left if m >> f & 1]
            assert got[k].tolist() == np.sum([[0, 0]] + [left[m] for m in out], axis=0).tolist()
            again[f] += got[k][0]
            left = {m: v for m, v in left.items() if m not in out}
    assert shapley.tolist() == again.tolist()


def brute_audit(rows, labels):
    said, least = {}, {}
    for d, q, t in (x for x in labels if x[0] is not None):
        a, b = said.get(d, (0, 0))
        said[d] = (a or int(q == 1), b or int(t == 1))
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = {}
    for d, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        docs.setdefault(lang or "", []).append((frozenset(k for k, v in fails.items() if v), *said.get(d, (0, 0))))
    out = []
    for part, own in docs.items():
        shapley, lines = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                fails = sum(f in x[0] for x in own)
                lines.append((part, order, k + 1, len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_op12_equals_brute_force(spark, docs_of, odd_rows):
    r = random.Random(2)
    rows = odd_rows + [(100 + i, " ".join(r.choice(["Word", "a#", "b", f"w{r.randrange(500)}"]) for _ in range(r.randrange(150, 260))), r.choice(["en", "de", "", None]), "s") for i in range(80)]
    rows += [(300 + i, rows[-1 - i % 3][1], "en", "s") for i in range(30)] + [(None, rows[-1][1], "en", "s"), (0, None, "fr", "s"), (301, rows[-1][1], "de", "s")]
    labels = [(100 + i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(120)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    want = brute_audit(rows, labels)
    got = sorted(map(tuple, op12_filter_audit(docs, said).collect()))
    assert got == want and len(got) == 600 * len({x[2] or "" for x in rows})
    names = ("mask", "part", "id", "good", "toxic", "h1", "n", "quality", "first", "least")
    assert sorted(map(tuple, op12_filter_audit(docs.selectExpr("*", *[f"1 as `{c}`" for c in names]), said.selectExpr("*", *[f"1 as `{c}`" for c in names if c not in ("quality", "toxic")])).collect())) == want
    assert op12_filter_audit(docs.limit(0), said).collect() == []
    assert len(op12_filter_audit(docs, said.limit(0)).collect()) == len(want)


# ---- pivot index ----


def brute_near(rows, cosine=0.98):
    """(n_links, component) of rows (id, vector, label), by comparing all."""
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    wide = max((len(v) for (_, v, _), o in zip(rows, ok, strict=True) if o), default=0)
    unit = [units(np.pad(np.array(v, float), (0, wide - len(v)))[None])[0] if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def clustered(seed, families=25, dims=24):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for f in range(families):
        centre = units(r.normal(size=(1, dims)))[0]
        for _ in range(int(r.integers(1, 30)) if f else 120):
            spread = r.choice([0.0, 0.05, 0.1, 0.14, 0.2])
            v = centre + spread * units(r.normal(size=(1, dims)))[0]
            rows.append((k, [float(np.float32(x)) for x in v * r.choice([1, 3.0])], int(f % 3)))
            k += 7
    return rows


@pytest.mark.parametrize("block", [16_384, 20])
def test_near_vectors_equal_brute_force(spark, block):
    rows = clustered(1)
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    got = sorted(map(tuple, near_vectors(spark, df, block=block).collect()), key=repr)
    want = brute_near(rows)
    assert sum(x[1] for x in want) > 3000
    assert got == want  # all pairs of these share enough pivots


def test_recall_at_the_threshold():
    """Pairs at a cosine of just 0.98 in 64 dimensions: the share that meets in the index."""
    r = np.random.default_rng(6)
    x = units(r.normal(size=(4000, 64)))
    z = r.normal(size=x.shape)
    z = units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    for n, least in ((256, 0.99), (4096, 0.93)):
        p = chosen(units(r.normal(size=(4 * n, 64))), n)
        a, b = permutation(x, p, 10), permutation(y, p, 10)
        assert np.mean([len(set(i) & set(j)) >= 6 for i, j in zip(a.tolist(), b.tolist(), strict=True)]) >= least
    assert (pivot_number(0), pivot_number(83_000), pivot_number(10**6), pivot_number(10**10)) == (256, 256, 4096, 4096)


def test_op11_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1)]
    rows += [(11, [1.0, 0.0, 0.0], 1), (12, [1.0], 1), (13, [0.0, 1.0], 1), (14, [1.0, 0.0], 2), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 3), (15, [1e300, 1e290], 1), (16, [-1.0, 0.0], 1), (17, [1e-200, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as node", "3 as v", "4 as place")
    got = sorted((tuple(r)[:3] for r in op11_pivot_near_dup(spark, df).collect()), key=repr)
    assert got == brute_near(rows)
    assert [r["kept"] for r in op11_pivot_near_dup(spark, df.where("vec_id in (1, 2)")).orderBy("vec_id").collect()] == [True, False]
    assert op11_pivot_near_dup(spark, df.limit(0)).collect() == []
    many = spark.range(3000).selectExpr("id as vec_id", "array(1.0F, 2.0F) as embedding", "1 as label")
    assert {tuple(r)[1:] for r in op11_pivot_near_dup(spark, many).collect()} == {(2999, 0, True), (2999, 0, False)}


@pytest.mark.parametrize("name", ["op11_pivot_near_dup", "op12_filter_audit"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_sql_of_near_vectors_on_a_fixture(spark):
    rows = clustered(2, families=8)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    got = con.sql(f"select vec_id, n_links, component_id from ({sql.OP11})").fetchall()
    assert sorted(got, key=repr) == brute_near(rows)
