"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd column names."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import merkle, metric_tree, periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24):
    ids, out = {}, {}
    v = np.array([ids.setdefault(w, len(ids)) for w in words])
    for q in range(1, len(v) // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (v[:-q] == v[q:]).astype(int), [0]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    block, window = rng.integers(0, 2 ** 20, (3, 8)).astype(np.uint64), rng.integers(0, 2 ** 20, (3, 15)).astype(np.uint64)
    window[0, 3:11] = block[0]
    for prime, generator in periodic_runs.PRIMES:
        rows = rng.integers(0, prime, (2, 32)).astype(np.uint64)
        assert (periodic_runs.restore(periodic_runs.transform(rows, prime, generator), prime, generator) == rows).all()
        got = periodic_runs.mismatches(block, window, prime, generator)
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(b, w[d:d + 8], strict=True)) % prime for d in range(8)] for b, w in zip(block, window, strict=True)]
        assert got.tolist() == want and got[0, 3] == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_runs_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rng, rows = random.Random(1), []
    for _ in range(300):
        n, k = rng.choice([0, 1, 23, 24, 25, 40, 200, 400]), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 30 else 0):
            p, s = rng.randint(1, n // 3), rng.randrange(n - 3)
            for i in range(s, min(n, s + rng.randint(2 * p, 5 * p))):
                w[i] = w[s + (i - s) % p]
        rows.append(w)
    first = np.concatenate(([0], np.cumsum([len(w) for w in rows])))
    assert periodic_runs.find_runs(np.array([v for w in rows for v in w]), first) == [brute_runs(w) for w in rows]


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b " * 12), (4, "a b " * 12), (None, "x " * 30), (5, "la " * 50_000 + "end"), (6, "a b " * 11 + "a")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `Text` string, `runs.start` int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 24, 2)], "a b"), (4, [(0, 24, 2)], "a b"), (None, [(0, 30, 1)], "x"),
                          (5, [(0, 50_000, 1)], "la end"), (6, [], " ".join(["a b"] * 11) + " a")], key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op12_equals_brute_force(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        want.append((d.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(tuple, queries.op12_block_convolution(spark, SF).collect()), key=str) == sorted(want, key=str)


def brute_manifest(rows, claimed):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(field, r)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        trees[x] = levels([leaf(r) for r in groups[x]])
    top, out = levels([trees[x][-1][0] for x in langs]), []
    for j, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            folded, proof = leaf(claimed(r)), ""
            for tree, at in ((trees[x], i), (top, j)):
                for level in tree[:-1]:
                    own = level[at // 8 * 8:at // 8 * 8 + 8]
                    proof += "".join(own[:at % 8] + own[at % 8 + 1:])
                    folded = digest("".join(own[:at % 8] + [folded] + own[at % 8 + 1:]))
                    at //= 8
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("upper", [1, 20, 1 << 16])
def test_merkle_equals_brute_force(spark, monkeypatch, upper):
    monkeypatch.setattr(merkle, "UPPER", upper)
    rng = random.Random(2)
    rows = [(i, rng.choice(["web", None, ""]), "en" if i % 3 else rng.choice(["de", None, "", "é"]), i, f"Text É {i} " * (i % 4)) for i in range(230)]
    rows += [(7, None, "en", None, None), (7, None, "en", None, None), (7, "z", "en", 1, "A"), (None, "s", "en", 1, "B"), (500, "s", "one", 1, "Long " * 100_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{COLUMNS}, `Text` string").repartition(5)
    before = spark.conf.get(merkle.ROW_LIMIT)
    got = merkle.manifest(docs, {"text": F.lower("text")}, F.col("doc_id") % 2 == 0).collect()
    assert spark.conf.get(merkle.ROW_LIMIT) == before
    changed = lambda r: (*r[:4], r[4].lower()) if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows, changed)


def test_merkle_of_one_row_one_group_and_none(spark):
    one = [(1, "s", "en", 1, "Ab")]
    same = lambda r: r
    for rows in (one, one + [(i, "s", "en", 1, "x") for i in range(2, 11)]):
        got = merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()
        assert sorted(map(tuple, got), key=str) == brute_manifest(rows, same)
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0


def test_op11_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 6))
    points[100:250] = points[7]  # many equal ones
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(900, [0.0] * 6), (901, None), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6),
             (None, [1.0] * 6), (905, [1.5, -2.0]), (1000, []), (300, rows[300][1])]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, `VEC_ID` double").repartition(4)
    known = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    ids = np.array(sorted(known))
    v = np.array([[int(np.floor(1024 * x)) for x in known[i]] + [0] * (6 - len(known[i])) for i in ids])
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        score, rest = v @ v[q], ids != ids[q]
        order = np.lexsort((ids[rest], -score[rest]))[:10]
        want += [(int(ids[q]), r + 1, int(ids[rest][o]), int(score[rest][o])) for r, o in enumerate(order)]
    for subtree in (8192, 120):
        assert sorted(map(tuple, metric_tree.nearest(frame, subtree=subtree).collect())) == sorted(want)
    assert metric_tree.nearest(frame.limit(0)).count() == 0
    few = metric_tree.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3)]


def test_pages_rule_out_distances_on_clustered_vectors():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(size=(40, 8)).repeat(50, axis=0) + 0.01 * rng.normal(size=(2000, 8))))
    space = metric_tree.Space(float((x * x).sum(axis=1).max()) * (1 + 1e-12), 8, True)
    ids = np.arange(2000)
    pages = metric_tree._paged(ids, x, np.full(2000, np.nan), space)
    assert max(len(p["entry"]) for p in pages) <= metric_tree.PAGE
    assert sorted(e for p in pages if p["leaf"] for e in p["entry"]) == list(range(2000))
    counts = [0, 0]
    for q in range(0, 2000, 100):
        got = metric_tree.best_first(pages, x[q], q, 10, space, float("nan"), -float("inf"), counts)
        score = x @ x[q]
        order = [o for o in np.lexsort((ids, -score)) if o != q][:10]
        assert got == [(int(score[o]), int(o)) for o in order]
    assert counts[0] < 0.5 * 20 * 2000 and counts[1] > 0


def test_op11_reads_the_table(spark):
    out = queries.op11_metric_tree(spark, SF)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and dict(out.dtypes)["score"] == "bigint" and out.count() == 50
