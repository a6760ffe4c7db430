"""Corpus operators: brute force on small fixtures, held-out accuracy, and the awkward cases of each."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import (line_quality, multiprobe, ngram_join, page_model, queries, repeated_phrases, secret_forest,
                          simhash_windows, soft_mixing, subword_language, word_shapes)
from tillroll.llm.graph import components
from tillroll.llm.words import Words, pack, unpack

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["w", "class", "token", "anchor", "hits", "score", "start", "findings", "p", "rate"]


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 99)) for _ in range(n))


def corpus():
    """Ids with texts: copies, near copies, shared passages, hot lines, nulls, empties, repeats, one long text."""
    rng = random.Random(4)
    passage, line = sentence(rng, 20), sentence(rng, 14)
    base = sentence(rng, 120)
    docs = [(1, base), (2, base), (3, base + " more words here"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  two")]
    for i in range(10, 40):
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"edit{i}"
        docs.append((i, " ".join(words)))
    for i in range(40, 70):
        docs.append((i, sentence(rng, 30) + "\n" + (passage if i % 3 else "") + "\n" + line + " " + sentence(rng, 10)))
    docs.append((70, " ".join([sentence(rng, 4000), passage, "same same " * 300])))
    docs.append((71, docs[-2][1]))
    return docs


def frame(spark, docs, types="doc_id long, text string"):
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*d, *EXTRA) for d in docs], f"{types}, {extra}").repartition(5)


def test_words_and_packing():
    column = pa.array(["a b  c\n d", None, "", "\x0b\x1cx é", "y"])
    words = Words(column)
    assert words.count.tolist() == [4, 0, 0, 2, 1]
    assert Words(pa.array(["é É ab AB", "ab"]), lower=True).hash[2:].tolist().count(Words(pa.array(["ab"])).hash[0]) == 3
    long = "x" * 200_000
    assert Words(pa.array([long + " " + long])).hash[0] == Words(pa.array(["a " + long])).hash[1]
    assert (unpack(pack(np.arange(9)), np.int64) == np.arange(9)).all()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(100 + i, 101 + i) for i in range(30)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + i: 100 for i in range(31)}
    assert components(links.limit(0)).count() == 0


def removed_by_hand(docs, window):
    first, out = {}, {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(a for a, b in zip(w, gone) if not b))
    return out


@pytest.mark.parametrize("window, gram", [(13, 5), (6, 3)])
def test_repeated_phrases(spark, window, gram):
    docs = corpus()
    got = repeated_phrases.remove_repeated(frame(spark, docs), window=window, gram=gram, shards=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == removed_by_hand(docs, window)


def test_repeated_phrases_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (3, long), (3, long), (2, long)]
    got = sorted(((r.doc_id or 0), r.n_removed) for r in repeated_phrases.remove_repeated(frame(spark, rows)).collect())
    assert got == [(0, 0), (2, 0), (3, 20), (3, 20)]
    assert repeated_phrases.remove_repeated(frame(spark, rows).limit(0)).count() == 0


def classes_by_hand(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(spark, size, percent):
    docs = corpus()
    got = ngram_join.near_duplicates(frame(spark, docs), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes_by_hand(docs, size, percent)


def test_ngram_join_awkward_rows(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "A b C d e"), (9, None)]
    got = sorted(map(tuple, ngram_join.near_duplicates(frame(spark, rows)).collect()))
    assert got == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9)]
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_base_spans_follow_the_patterns():
    patterns = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
                2: r"[0-9](?:[\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1.9@-+ (%5é\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "a@b.c@d.e @x.y a@@b.c", "+1 (555) 010-9999.", ""]
    for text in texts:
        want = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                fits = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                        16 <= len(digits) <= 19 and word_shapes.luhn(digits), 8 <= len(digits) <= 15)[kind]
                if fits:
                    want.append((kind, *m.span()))
        assert word_shapes.base_spans(text) == want, text
    assert word_shapes.base_spans("9" * 50_000 + "@" * 1000) == []


def test_word_shapes(spark):
    model = word_shapes.train(word_shapes.labelled_lines())
    held = word_shapes.labelled_lines(300, seed=77)
    got = word_shapes.model_spans([t for t, _ in held], [[] for _ in held], model)
    assert sum(sorted(a) == sorted(b) for a, (_, b) in zip(got, held)) >= 0.93 * len(held)
    rows = [(1, "call (555) 123-4567 now, or mail a.b@mail.example.com"), (2, None), (3, ""), (None, "+44 20 7946 0958"), (1, "x" * 100_000 + " 10.0.0.1")]
    out = word_shapes.find_personal(frame(spark, rows), model).collect()
    kinds = sorted((len(r.base), sorted(s.kind for s in [*r.base, *r.added])) for r in out)
    assert kinds == [(0, []), (0, []), (1, ["email", "phone"]), (1, ["ip"]), (1, ["phone"])]
    assert word_shapes.find_personal(frame(spark, rows).limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = word_shapes.ShapeModel(rng.normal(size=(word_shapes.SPACE, word_shapes.LABELS)).astype(np.float32), rng.normal(size=(5, 5)).astype(np.float32))
    lines = [rng.integers(0, word_shapes.SPACE, (n, 8)) for n in (1, 4, 3)]
    for features, labels in zip(lines, model.decode(lines)):
        e = model.weights[features].sum(axis=1)
        total = lambda path: sum(e[i, x] for i, x in enumerate(path)) + sum(model.change[a, b] for a, b in zip(path, path[1:]))
        best = max(np.ndindex(*[5] * len(e)), key=total)
        assert tuple(labels) == best


def test_line_quality(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    out = queries.op4_line_quality(spark, f"{SF}/../sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.93
    model = line_quality.fit(docs, labels)
    rows = [(1, "good words here"), (2, None), (3, ""), (4, " \n "), (None, "a b"), (1, "a***\n" * 3000)]
    got = {(r.doc_id, round(r.score, 6)) for r in line_quality.score_documents(frame(spark, rows), model).collect()}
    assert {(2, 0.0), (3, 0.0), (4, 0.0)} <= got and len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    assert line_quality.fit(docs.limit(0), labels).constant == 0.5
    one = line_quality.train(pa.array(["a b", "c"]), np.array([1, 1]))
    assert line_quality.scores(one, pa.array(["x", None])).tolist() == [1.0, 1.0]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    doc, emission, change = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=6), rng.normal(size=(2, 2))
    good, pairs = line_quality.marginals(emission, doc, change)
    want = np.zeros(6)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weight = {p: np.exp(sum(emission[i] * x for i, x in zip(at, p)) + sum(change[a, b] for a, b in zip(p, p[1:]))) for p in np.ndindex(*[2] * len(at))}
        for k, i in enumerate(at):
            want[i] = sum(v for p, v in weight.items() if p[k]) / sum(weight.values())
    assert np.allclose(good, want) and np.isclose(pairs.sum(), 3)


def test_secret_forest(spark):
    forest = secret_forest.train(secret_forest.labelled_findings())
    held = secret_forest.labelled_findings(300, seed=8)
    guess = forest.probability(np.array([secret_forest.features(t, a, b) for t, a, b, _ in held])) >= 0.5
    assert np.mean(guess == np.array([y == 1 for *_, y in held])) > 0.97
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [(1, f'é token = "{key}" and commit {key}'), (2, None), (3, ""), (None, "plain words only"), (3, "a1" * 60_000)]
    out = secret_forest.scan(frame(spark, rows), forest).collect()
    one = next(r for r in out if r.doc_id == 1)
    assert one.redacted == f'é token = "[secret]" and commit {key}' and one.n_candidates == 2
    assert next(r for r in out if r.doc_id == 2).redacted is None and len(out) == 5
    assert secret_forest.scan(frame(spark, rows).limit(0), forest).count() == 0


def test_soft_mixing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), soft_mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    extra = frame(spark, [(5001, None), (5002, ""), (None, "a b"), (7, "a b"), (7, "a b")]).select("doc_id", "text")
    out = soft_mixing.mix(docs.select("doc_id", "text").union(extra), labels, soft_mixing.TARGETS).toPandas()
    p = out[["p_good", "p_low", "p_toxic"]].to_numpy()
    assert len(out) == docs.count() + 5 and np.allclose(p.sum(axis=1), 1) and (out.rate >= 0).all()
    got = (out.n_tokens.to_numpy()[:, None] * out.rate.to_numpy()[:, None] * p).sum(axis=0) / out.n_tokens.sum()
    assert np.allclose(got, [0.425, 0.025, 0.05], atol=0.005)
    assert ((out.copies >= np.floor(out.rate)) & (out.copies <= np.ceil(out.rate))).all()
    assert soft_mixing.mix(docs.limit(0), labels, soft_mixing.TARGETS).count() == 0
    even = soft_mixing.mix(docs, labels.limit(0), {"x": 1.0, "y": 1.0}).first()
    assert even.p_x == even.p_y == 0.5


def test_rates_equal_projected_gradient_in_numpy(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([0.3, 0.3], 50), rng.integers(1, 90, 50)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    got = members.withColumn("r", soft_mixing.fit_rates(members, [0.9, 0.1], steps=11, tolerance=0)).toPandas()
    rate, goal, before = np.full(50, 0.5), np.array([0.9, 0.1]) * 0.5 * n.sum(), np.inf
    for _ in range(11):
        gap, active = goal - (n * rate) @ p, rate > 0
        left = max(abs(gap) / goal)
        plain = gap / (n[:, None] * p).sum(axis=0)
        scaled = np.linalg.solve((p[active] * n[active, None]).T @ p[active], gap)
        rate, before = np.maximum(0, rate + p @ (plain if left > 0.9 * before else scaled)), left
    assert np.allclose((n * rate) @ p, goal)
    order = lambda a, b: sorted(zip(a, b))
    assert np.allclose(order(got.n_tokens, got.r), order(n, rate))


def test_simhash_windows(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randint(20, 60))) for i in range(12)] + [(90, "tiny item"), (91, None), (92, ""), (None, "x y z a b c")]
    docs = []
    for i in range(40):
        words = sentence(rng, 80).split()
        if i % 2:
            part = items[i % 12][1].split()
            if i % 4 == 1:
                part[len(part) // 2] = "changed"
            if i % 8 == 7:
                part = part[:len(part) // 2]
            at = (0, 40, len(words))[i % 3]
            words[at:at] = part
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(50, "a tiny item here"), (51, None), (52, ""), (None, items[0][1]), (1, docs[1][1])]
    got = simhash_windows.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    count = lambda w: collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    want = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j, s in items:
            v = (s or "").lower().split()
            for k in range(max(1, len(w) - len(v) + 1)) if v and w and i is not None and j is not None else ():
                a, b = count(w[k:k + len(v)]), count(v)
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both)
                if s >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), s)
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got.collect()} == want and (50, 90) in want
    none = frame(spark, items, "item_id long, text string").limit(0)
    assert simhash_windows.contaminated(frame(spark, docs), none).count() == 0
    shuffled = simhash_windows.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"), broadcast_rows=0)
    assert sorted((r.doc_id, r.item_id) for r in shuffled.collect()) == sorted(want)


def test_blocks_reach_every_hash_within_the_radius():
    rng = random.Random(3)
    for _ in range(2000):
        bits = rng.sample(range(64), simhash_windows.RADIUS)
        assert min(sum(b // 8 == i for b in bits) for i in range(8)) <= 2


def test_subword_language(spark):
    out = queries.op8_subword_language(spark, f"{SF}/../sf0.01").join(
        spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = subword_language.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "and the of that with this"), (3, "the and that " * 20_000)]
    got = sorted((r.doc_id or 0, r.lang_pred, r.rejected) for r in subword_language.identify(frame(spark, rows), model).collect())
    assert got == [(0, "en", False), (1, "und", True), (2, "und", True), (3, "en", False), (3, "und", True)]
    assert {r.lang_pred for r in subword_language.identify(docs, subword_language.train([], [])).collect()} == {"und"}


def test_multiprobe(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    x[100:140] = x[100]  # one frequent vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, []), (740, [0.0] * 16), (760, [1.0, None] * 8), (780, [float("nan")] * 16), (800, [1.0, 2.0]), (None, x[0].tolist())]
    got = multiprobe.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 600, 20))
    hit = 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        hit += len(set(order) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, score[part.vec_id])
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(part.score, part.score[1:], part.vec_id, part.vec_id[1:]))
    assert hit >= 0.9 * 600
    few = multiprobe.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), reach=0.9999)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert multiprobe.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_page_model(spark):
    model = page_model.train(page_model.labelled_pages())
    held = page_model.Forest([(p, p.blocks()) for p in map(page_model.Page, page_model.labelled_pages(80, seed=3))])
    assert np.mean((model.marginals(held)[0] >= 0.5) == held.truth) > 0.98
    page = ("<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav>"
            "<article><h1>Head &amp; line here.</h1><p>One  two\n three words go here.<br>Four five six.<p>Next &eacute; block is here."
            "<div class=ad>Buy it now.</div></article><section class=\"comments\"><div class=comment><p>I think so too.</p></div></section>"
            "<footer>&copy; someone</footer>")
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p>unclosed <b>text < 5 & more. Words and words."), (3, "u", "<div>" * 3000)]
    out = page_model.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string"), model).collect()
    texts = {(r.page_id, r.url): r.text for r in out}
    assert texts[1, "u"] == "Head & line here.\nOne two three words go here. Four five six.\nNext é block is here."
    assert texts[2, "u"] == texts[3, None] == texts[3, "u"] == "" and len(out) == 5


def test_tree_marginals_equal_enumeration():
    page = page_model.Page("<div><p>a</p><ul><li>b</li></ul></div>")
    f = page_model.Forest([(page, page.blocks())])
    rng = np.random.default_rng(0)
    model = page_model.TreeModel(rng.normal(size=page_model.SLOTS) * 0.3, rng.normal(size=(page_model.KINDS, 2, 2)))
    unary = np.bincount(f.node, weights=model.unary[f.slot], minlength=5)
    weight = {y: np.exp(sum(unary[i] * v for i, v in enumerate(y)) + sum(model.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, 5)))
              for y in np.ndindex(*[2] * 5)}
    want = [sum(v for y, v in weight.items() if y[i]) / sum(weight.values()) for i in range(5)]
    assert np.allclose(model.marginals(f)[0], want)


def test_digest_queries(spark):
    for name in ("op1_repeated_phrases", "op2_ngram_join", "op3_word_shapes", "op5_secret_forest", "op10_page_model"):
        assert queries.llm_queries()[name](spark, SF).count() > 0, name
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = removed_by_hand(sorted(docs.items()), 13)
    for r in queries.op1_repeated_phrases(spark, SF).collect():
        assert (r.n_words, r.n_removed) == want[r.doc_id][:2] and r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()
