"""Jaccard join, graphs, language models and the classifier against brute force and held-out rows."""

import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import common, gram_parts, hnsw, jaccard_join, kneser_ney, lattice_lm, toxicity
from lexiquarry.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, size long"


def shingles(t):
    w = (t or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def brute_links(rows):
    sets = [shingles(t) for t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return links, {i: min(g) for g in groups.values() for i in g}


def test_jaccard_brute(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))] for _ in range(12)]
    common = [f"c{i}" for i in range(60)]
    texts = [None, "", "  ", "one", "one", "two words", "two words"]
    for b in base:
        for _ in range(rng.choice([1, 3, 50])):
            c = list(b)
            for _ in range(rng.randrange(0, 4)):
                c[rng.randrange(len(c))] = "edit" + str(rng.random())
            texts.append(" ".join(c))
    for _ in range(80):  # texts that share one passage
        texts.append(" ".join([f"u{rng.random()}" for _ in range(60)] + common))
    frame = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], DOCS)
    links, classes = brute_links(texts)
    got = jaccard_join.joined(frame).collect()
    assert {r["doc_id"]: r["nj_class_id"] for r in got} == classes
    assert {r["doc_id"]: r["nj_n_links"] for r in got} == {i: links[i] for i in range(len(texts))}
    kept = jaccard_join.keep(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes.values()))


def test_jaccard_blocks(spark, monkeypatch):
    """Groups larger than a block, and small nodes turned off, give the same links."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        c = list(base)
        c[rng.randrange(120)] = f"e{i}"
        texts.append(" ".join(c))
    frame = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], DOCS)
    links, classes = brute_links(texts)
    monkeypatch.setattr(jaccard_join, "BLOCKS", (20, 20))
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    got = jaccard_join.joined(frame).collect()
    assert {r["doc_id"]: r["nj_n_links"] for r in got} == {i: links[i] for i in range(90)}
    assert {r["doc_id"]: r["nj_class_id"] for r in got} == classes


def test_jaccard_hard_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "a b c d e f", "en", "s", 0), (None, None, "en", "s", 0), (2, "x " * 30_000, "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = jaccard_join.joined(frame).collect()
    assert sorted((str(r["doc_id"]), str(r["nj_class_id"]), r["nj_n_links"], r["nj_n_copies"]) for r in got) == sorted([("1", "1", 3, 3)] * 3 + [("None", "1", 3, 3), ("None", "None", 0, 0), ("2", "2", 0, 0)])
    assert jaccard_join.keep(frame).count() == 3
    assert jaccard_join.keep(frame.limit(0)).count() == 0
    clash = frame.selectExpr("*", "1 AS copies", "2 AS links", "3 AS head", "4 AS id", "5 AS root", "6 AS key", "7 AS row", "8 AS at", "9 AS n")
    more = jaccard_join.joined(clash)
    assert [c for c in more.columns if not c.startswith("nj_")] == clash.columns
    assert sorted(map(str, more.select("doc_id", "nj_class_id", "nj_n_links", "nj_n_copies").collect())) == sorted(map(str, jaccard_join.joined(frame).select("doc_id", "nj_class_id", "nj_n_links", "nj_n_copies").collect()))


def test_runs():
    assert jaccard_join.runs_needed(0.8, 0.9999, 2) == 4


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000 + i, 9999) for i in range(40)]
    parent = {v: v for e in edges for v in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, queries, top=20):
    out = {}
    for q, v in queries:
        scored = sorted(((-float((np.asarray(x, float) * np.asarray(v, float)).sum()), i) for i, x in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def test_hnsw_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 20 == 0])
    for got in (hnsw.op6_hnsw(spark, SF), hnsw.search(hnsw.build_index(vectors, shard=120), vectors.filter("vec_id % 20 = 0"), block=7)):
        found = defaultdict(list)
        for r in got.orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert all([s for _, s in x] == sorted((s for _, s in x), reverse=True) for x in found.values())
        recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])
        assert recall >= 0.95 and set(found) == set(want)


def test_hnsw_hard_rows(spark):
    rng = np.random.default_rng(1)
    same = [1.0] * 8
    rows = [(k, same) for k in range(100)] + [(1000 + k, (rng.normal(size=8) * rng.integers(1, 9)).tolist()) for k in range(60)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] + [1.0] * 6), (2080, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, same), (2120, [1.0, 2.0]), (2140, [2.0, 1.0]), (40, same)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = hnsw.search(hnsw.build_index(frame, shard=50), frame.filter("vec_id % 20 = 0")).collect()
    want = brute_nearest([(i, [float(np.float32(x)) for x in v]) for i, v in rows], [(i, v) for i, v in rows if i % 20 == 0])
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r["vec_id"])
    assert by.pop(2120) == [2140] and by.pop(2140) == [2120]
    assert set(by) == set(want)
    for q in (0, 20, 40, 60, 80):
        assert by[q] == [i for i, _ in want[q]]
    assert hnsw.search(hnsw.build_index(frame.limit(0)), frame).count() == 0


def test_lattice_sums_all_segmentations():
    path = lattice_lm.default_vocabulary()
    lp, end = lattice_lm.initial(path)
    hashes, starts, _, _ = lattice_lm.pieces(path)
    at = {int(h): k for k, h in enumerate(hashes)}
    other, other_end = lattice_lm.scores_of(np.linspace(1, 2, len(lp)), starts, 3.0)
    lattice = lattice_lm.Lattice(path, np.stack([other, lp]), np.asarray([other_end, end]))

    def brute(word):
        n, total = len(word), 0.0
        for cuts in itertools.product((0, 1), repeat=n - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
            ids = [at.get(lattice_lm._hash(word[a:b])) for a, b in zip(edges, edges[1:])]
            if None not in ids:
                total += math.exp(sum(lp[k] for k in ids))
        return math.log(total) + end

    for w in (b"the", b"x", b"ontion", "é9".encode(), b"$$a"):
        (_, rows), *_ = lattice_lm.by_length([w])
        assert lattice.log_probability(rows)[0, 1] == pytest.approx(brute(b" " + w))
    assert np.exp(lp[starts]).sum() == pytest.approx(1) and np.exp(lp[~starts]).sum() + math.exp(end) == pytest.approx(1)
    uses = np.zeros(len(lp))
    lattice.expected(next(lattice_lm.by_length([b"thing"]))[1], 1, uses)
    assert (uses * np.asarray([1]))[starts].sum() == pytest.approx(1)


def test_lattice_of_long_words(monkeypatch):
    """Stretch by stretch as all at once, with pieces of every length."""
    path = lattice_lm.default_vocabulary()
    lp, end = lattice_lm.initial(path)
    lattice = lattice_lm.Lattice(path, np.stack([lp, lp[::-1] - 1]), np.asarray([end, end]))
    assert lattice.lengths[-1] > 60
    monkeypatch.setattr(lattice_lm, "STRETCH", 7)
    for word in (b"responsibilities" * 5, b"-" * 90 + b"abc", "日本語".encode() * 20, b"x", b"responsibilities"):
        (_, rows), *_ = lattice_lm.by_length([word])
        assert lattice.long_word(word) == pytest.approx(lattice.log_probability(rows)[0])
        many, one = np.zeros(len(lp)), np.zeros(len(lp))
        lattice.expected(rows, 0, many)
        lattice.long_expected(word, 0, one)
        assert one == pytest.approx(many)
    assert not list(lattice_lm.by_length([b"x" * 300]))
    assert np.isfinite(lattice.long_word(bytes(range(33, 64)) * 4000)).all()


def test_lattice_query(spark):
    import zlib

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    c = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t.encode().lower().split())
            c[None] += 1
    n, v, texts = sum(c.values()), len(c), dict(docs)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    few = lattice_lm.score_documents(whole.select("doc_id", "lang", "text"), sent_words=20)  # most words meet their scores in the join
    for rows in (lattice_lm.op9_lattice_lm(spark, SF).collect(), few.withColumnsRenamed({x: x.removeprefix("lm_") for x in few.columns}).collect()):
        held = [0.0, 0.0]
        for r in rows:
            words = [*texts[r["doc_id"]].encode().lower().split(), None]
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
            assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
            if r["held_out"]:
                held[0] += r["base_score"]
                held[1] += r["score"]
        assert held[1] > 1.2 * held[0]  # the base gives all unseen words one word's share, so on a few texts it stays ahead
    hard = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "word " * 5 + "x" * 3000, None), (2, "word " * 5 + "x" * 3000, None)], "doc_id long, text string, lang string")
    got = lattice_lm.score_documents(hard).collect()
    assert len(got) == 4 and all(math.isfinite(r["lm_score"]) for r in got)
    assert lattice_lm.score_documents(hard.limit(0)).count() == 0


def brute_kn(texts, discounts):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    tri, cont2, cont1 = Counter(), defaultdict(set), defaultdict(set)
    for t in texts:
        w = ["<s>", "<s>", *t.lower().split(), "</s>"]
        for a, b, c in zip(w, w[1:], w[2:]):
            tri[a, b, c] += 1
    for a, b, c in tri:
        cont2[b, c].add(a)
    two = {k: len(s) for k, s in cont2.items()}
    for b, c in two:
        cont1[c].add(b)
    uni = {k: len(s) for k, s in cont1.items()}
    d = lambda k, n: discounts[k][min(n, 3) - 1]
    total = sum(uni.values())
    rest = sum(d(0, n) for n in uni.values()) / total / (len(uni) + 1)

    def p(a, b, c):
        p1 = (uni[c] - d(0, uni[c])) / total + rest if c in uni else rest
        own = {k: n for k, n in two.items() if k[0] == b}
        p2 = p1
        if own:
            s = sum(own.values())
            p2 = (max(two.get((b, c), 0) - d(1, two[b, c]), 0) if (b, c) in two else 0) / s + sum(d(1, n) for n in own.values()) / s * p1
        own = {k: n for k, n in tri.items() if k[:2] == (a, b)}
        if not own:
            return p2
        s = sum(own.values())
        return ((tri[a, b, c] - d(2, tri[a, b, c])) if (a, b, c) in tri else 0) / s + sum(d(2, n) for n in own.values()) / s * p2

    return p, [Counter(x.values()) for x in (uni, two, tri)]


def test_kneser_ney_brute(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser_ney.arrays(kneser_ney.fitted(frame))
    counts = brute_kn(texts, [[0.5, 1.0, 1.5]] * 3)[1]
    found = [kneser_ney.discounts(spark.createDataFrame([(n,) for n, k in c.items() for _ in range(k)], "n long")) for c in counts]
    p, _ = brute_kn(texts, found)
    grams = kneser_ney.Grams()
    for t in ("a b c", "zz a b zz", "", "g g g g a"):
        w = ["<s>", "<s>", *t.split(), "</s>"]
        want = sum(math.log(p(*x)) for x in zip(w, w[1:], w[2:]))
        assert kneser_ney.log_likelihood(model, grams(t)) == pytest.approx(want, rel=1e-4)
    some = [*texts, "a b c", "zz a b zz", "", None, "g g g g a"]
    joined = kneser_ney.likelihoods_by_joins(spark.createDataFrame([(t,) for t in some], "text string"), kneser_ney.fitted(frame)).collect()
    assert sorted(r["log_likelihood"] for r in joined) == pytest.approx(sorted(kneser_ney.log_likelihood(model, grams(t)) for t in some), rel=1e-4)
    assert sum(r["n_tokens"] for r in joined) == sum(len((t or "").split()) + 1 for t in some)
    vocabulary = ["a", "b", "c", "d", "e", "f", "g", "</s>"]
    assert sum(p("a", "b", x) for x in [*vocabulary, "unseen"]) == pytest.approx(1)


def test_kneser_ney_keeps_like_text(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(40)) for _ in range(400)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)] + [(1000 + i, " ".join(f"junk{rng.random()}" for _ in range(40)), "en", "s", 0) for i in range(20)] + [(3000, None, "xx", "s", 0), (None, "", None, "s", 0)]
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kn_kept"] for r in kneser_ney.judged(frame, labels, rows=200).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(400)) >= 390 and got[3000] and got[None]
    assert kneser_ney.judged(frame.limit(0), labels).count() == 0
    assert all(r["kn_kept"] for r in kneser_ney.judged(frame, labels.limit(0)).collect())


@pytest.mark.parametrize("options", [{}, {"model_rows": 0}])
def test_kneser_ney_fits_all_trusted(spark, options):
    """However many the trusted rows are, all but the held ones are fitted; by arrays and, where the model is too large for these, by joins."""
    rng = random.Random(5)
    texts = [f"own{i} " + " ".join(rng.choice("a b c d".split()) for _ in range(rng.randrange(0, 6))) for i in range(2600)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, None, None, "s", 0), (5000, "zz a", "fr", "s", 0)], DOCS).repartition(3)
    part = {r[0]: r[1] for r in frame.selectExpr("doc_id", "pmod(xxhash64('threshold', doc_id), 3)").collect()}
    fit = [t for i, t in enumerate(texts) if part[i]]
    assert len(fit) > 1600
    counts = brute_kn(fit, [[0.5, 1.0, 1.5]] * 3)[1]
    p, _ = brute_kn(fit, [kneser_ney.discounts(spark.createDataFrame([(n,) for n, k in c.items() for _ in range(k)], "n long")) for c in counts])
    labels = spark.createDataFrame([(i, 1) for i in range(2600)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(frame, labels, **options).collect()}
    assert len(got) == 2602
    for i, t in [*enumerate(texts[:20]), (5000, "zz a"), (None, "")]:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        assert got[i]["kn_n_tokens"] == len(w) - 2
        assert math.log(got[i]["kn_perplexity"]) == pytest.approx(-sum(math.log(p(*x)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2), rel=1e-4)


@pytest.mark.parametrize("codes, parts", [(1 << 20, 12), (5, 40), (40, 3)])
def test_kneser_ney_parts(spark, monkeypatch, codes, parts):
    """Scores by parts against the definition, with words beyond the numbered ones and words dealt over several parts; equal texts have equal scores."""
    monkeypatch.setattr(gram_parts, "CODES", codes)
    monkeypatch.setattr(gram_parts, "PARTS", parts)
    monkeypatch.setattr(gram_parts, "TOGETHER", 500)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("The the THE of of a") if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    new = ["unseen words only", "the unseen of the", "", *texts[:10]]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + new)] + [(None, None, None)], "doc_id long, text string, lang string").repartition(3)
    p, _ = brute_kn(texts, [kneser_ney.discounts(spark.createDataFrame([(n,) for n, k in c.items() for _ in range(k)], "n long")) for c in brute_kn(texts, [[0.5, 1.0, 1.5]] * 3)[1]])
    got = {r["doc_id"]: r for r in gram_parts.by_parts(frame, spark.range(300).withColumnRenamed("id", "doc_id"), 1.1, "x_").collect()}
    assert len(got) == 314 and set(got[0].asDict()) == {"doc_id", "lang", "x_n_tokens", "x_perplexity"}
    for i, t in [*enumerate(texts + new), (None, "")]:
        w = ["<s>", "<s>", *t.lower().split(), "</s>"]
        assert got[i]["x_n_tokens"] == len(w) - 2
        assert math.log(got[i]["x_perplexity"]) == pytest.approx(-sum(math.log(p(*x)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2), rel=1e-5)
    assert all(got[i]["x_perplexity"] == got[303 + i]["x_perplexity"] for i in range(10))


def test_kneser_ney_writes_little(spark, monkeypatch):
    """All tables that a fit and the scores beyond arrays write, none deleted, take few bytes for a position."""
    monkeypatch.setattr(common, "remove", lambda spark, paths: None)
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(1000)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(2)
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(x.stat().st_size for x in folder.rglob("*.parquet"))
    before = size()
    assert kneser_ney.judged(frame, spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int"), model_rows=0).count() == 300
    assert size() - before < 10 * 300 * 1001


def test_kneser_ney_thresholds_of_few(spark):
    """At the default bound, few trusted rows give thresholds too, and a language with under 50 of them has that of all."""
    rng = random.Random(3)
    like = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(40))
    junk = lambda: " ".join(f"junk{rng.random()}" for _ in range(40))
    rows = [(i, like(), "en" if i < 250 else "fr", "s", 0) for i in range(300)] + [(1000 + i, junk(), lang, "s", 0) for i, lang in enumerate(["en", "fr", "xx", None])] + [(2000, "", "fr", "s", 0)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert not any(got[1000 + i]["kn_kept"] for i in range(4)) and sum(got[i]["kn_kept"] for i in range(300)) >= 285 and got[2000]["kn_kept"]
    assert got[0]["kn_threshold"] is not None and got[299]["kn_threshold"] == got[1002]["kn_threshold"] == got[1003]["kn_threshold"]
    few = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r["doc_id"] for r in kneser_ney.judged(spark.createDataFrame(rows, DOCS), few).filter("NOT kn_kept").collect()} >= {1000, 1001, 1002, 1003}


def test_toxicity_learns(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Awful!", "horrid", "vile,"])
        rows.append((i, " ".join(w), "en" if i % 2 else None, "s", 0))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame([*rows, (None, None, "en", "s", 0), (9999, "", None, "s", 0), (9998, "vile " * 20_000, "en", "s", 0)], DOCS)
    known = spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, toxic int")
    model, thresholds = toxicity.trained(frame, known, steps=600)
    got = {r["doc_id"]: r for r in toxicity.scored(frame, model, thresholds).collect()}
    held = [i for i in range(1500) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i]["tox_score"] >= 0.5) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95 and got[9998]["tox_score"] > 0.5 and 0 <= got[9999]["tox_score"] < 0.5 and 0 <= got[None]["tox_score"] <= 1
    again = toxicity.trained(frame, known, steps=600)[0]
    assert np.array_equal(model.embedding, again.embedding)
    assert toxicity.keep(frame.limit(0), known).count() == 0
    assert toxicity.scored(frame, *toxicity.trained(frame, known.limit(0))).filter("tox_score > 0.5").count() == 0
    alone = {r["doc_id"]: r["tox_score"] for r in toxicity.scored(frame.repartition(37), model, thresholds).collect()}
    assert alone == pytest.approx({i: r["tox_score"] for i, r in got.items()}, abs=1e-5)  # whatever stands beside it
    swapped = {r["doc_id"]: r["tox_score"] for r in toxicity.scored(frame.withColumn("lang", F.lit("zz")), model, thresholds).collect()}
    assert swapped == {i: r["tox_score"] for i, r in got.items()}


def test_toxicity_thresholds_of_all_rows(spark):
    """However small the sample and long the texts, every labelled row that isn't fitted counts for its language's threshold."""
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1600):
        lang = "long" if i % 8 == 7 else "en" if i % 2 else None
        w = [rng.choice(vocabulary) for _ in range(2500 if lang == "long" else 40)]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "vile"
        rows.append((i, " ".join(w), lang, "s", 0))
    frame = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1600)], "doc_id long, toxic int")
    assert set(toxicity.trained(frame, known, rows=100, steps=300)[1]) == {"*", "en", "long", None}


def test_toxicity_few_labels(spark):
    """30 toxic labels calibrate, all of them; with 10, what is predicted toxic is rejected."""
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = [" ".join([rng.choice(vocabulary) for _ in range(30)] + ["vile"] * (i % 5 == 0)) for i in range(400)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5]
    for n, own in ((30, {"*", "en"}), (10, {"*"})):
        toxic = [i for i in ids if i % 5 == 0][:n]
        known = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in ids if i % 5][:200], "doc_id long, toxic int")
        model, thresholds = toxicity.trained(frame, known, steps=300)
        assert set(thresholds) == own
        if n == 10:
            assert thresholds == {"*": 0.5}
            assert toxicity.scored(frame, model, thresholds).filter("tox_rejected != (tox_score >= 0.5)").count() == 0


def test_toxicity_forward_brute(spark):
    """Scores and verdicts straight from the definition: windows over the padded text, maxima, one logistic layer."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) + (" vile!" if i % 5 == 0 else "") for i in range(400)]
    frame = spark.createDataFrame([*((i, t, "en" if i % 3 else None, "s", 0) for i, t in enumerate(texts)), (1000, None, "zz", "s", 0)], DOCS)
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model, thresholds = toxicity.trained(frame, known, steps=200)
    words = toxicity.Words()

    def score(text):
        ids = words(text)
        e = [model.embedding[a] + model.embedding[b] for a, b in ids]
        z = model.bias
        zero, at = np.zeros(toxicity.DIM), 0
        for w, f, b in zip(toxicity.WIDTHS, model.filters, model.biases):
            padded = [*e, *[zero] * max(toxicity.WIDTHS)]
            tops = np.max([sum(padded[k + j] @ f[j * toxicity.DIM : (j + 1) * toxicity.DIM] for j in range(w)) for k in range(len(e) + 1)], axis=0)
            z += np.maximum(tops + b, 0) @ model.weights[at : at + toxicity.FILTERS]
            at += toxicity.FILTERS
        return 1 / (1 + math.exp(-(model.scale * z + model.shift)))

    for r in toxicity.scored(frame, model, thresholds).collect():
        want = score(r["text"])
        assert r["tox_score"] == pytest.approx(want, abs=1e-4)
        limit = thresholds.get(r["lang"], thresholds["*"])
        assert abs(want - limit) < 1e-3 or r["tox_rejected"] == (want >= limit)
    assert toxicity.keep(frame.selectExpr("*", "1 AS score", "2 AS rejected", "3 AS step", "4 AS n"), known).columns == [*frame.columns, "score", "rejected", "step", "n"]


def test_kneser_ney_query_brute(spark):
    """op5 on its table: which rows are fitted and which set thresholds, perplexities and verdicts, from the definition."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r for r in docs.collect()}
    trusted = {r["doc_id"] for r in kneser_ney.trusted_ids(labels).collect()}
    part = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64('threshold', doc_id), 3)").collect()}
    fit = [text[i]["text"] or "" for i in trusted if part[i]]
    counts = brute_kn(fit, [[0.5, 1.0, 1.5]] * 3)[1]
    p, _ = brute_kn(fit, [kneser_ney.discounts(spark.createDataFrame([(n,) for n, k in c.items() for _ in range(k)], "n long")) for c in counts])
    got = {r["doc_id"]: r for r in kneser_ney.op5_kneser_ney(spark, SF).collect()}
    held = sorted((got[i]["perplexity"], text[i]["lang"]) for i in trusted if not part[i])
    for i in list(text)[:40]:
        w = ["<s>", "<s>", *(text[i]["text"] or "").lower().split(), "</s>"]
        assert len(w) < 4 or len(w) > 300 or math.log(got[i]["perplexity"]) == pytest.approx(-sum(math.log(p(*x)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2), rel=1e-3)
    assert len(held) < 50  # so every language has the quantile of all, the least value that 99 of 100 don't exceed
    limit = [x for x, _ in held][math.ceil(0.99 * len(held)) - 1]
    assert {r["threshold"] for r in got.values()} == {limit}
    assert {i: r["kept"] for i, r in got.items()} == {i: r["perplexity"] <= limit or r["n_tokens"] == 1 for i, r in got.items()}
    assert not all(r["kept"] for r in got.values())


def test_lattice_mixture_is_a_probability(spark):
    """Scores of a text are the sum over languages of prior times the words' probabilities, by the definition on a tiny table."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aa bb aa", "x"), ("bb cc", "x"), ("dd dd ee", "y"), ("aa ff", None), ("gg aa", "x"), ("", "y"), ("dd", "y"), ("aa bb", "x")])]
    import zlib

    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    got = {r["doc_id"]: r["lm_score"] for r in lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    langs = [k for k, _ in sorted(Counter(lang for _, _, lang in train if lang).items(), key=lambda x: (-x[1], x[0]))]
    place = {k: i for i, k in enumerate(langs)}
    models = len(langs) + 1
    by = [Counter() for _ in range(models)]
    ends = Counter()
    for _, t, lang in train:
        by[place.get(lang, models - 1)].update(t.encode().split())
        ends[place.get(lang, models - 1)] += 1
    every = sum(by, Counter())
    n, texts = sum(every.values()), len(train)
    once, twice = (sum(v == k for v in every.values()) for k in (1, 2))
    stats = {"discount": min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.75, "n_words": n, "n_by": [sum(c.values()) for c in by], "kinds_by": [len(c) for c in by], "p_end": (texts + 1) / (n + texts + 2)}
    words = spark.createDataFrame([(w, *(c[w] for c in by), every[w]) for w in every], "word binary, " + ", ".join(f"c{k} long" for k in range(models)) + ", c long")
    path = lattice_lm.default_vocabulary()
    lattice = lattice_lm.Lattice(path, *lattice_lm.fitted_pieces(words, models, path))

    def score(t):
        total = 0.0
        for k in range(models):
            z = (ends[k] + 1) / (texts + models)
            for w in t.encode().split():
                sub = lattice.log_probability(next(lattice_lm.by_length([w]))[1])
                z *= math.exp(lattice_lm.word_scores(sub, np.asarray([every[w]], float), [np.asarray([c[w]], float) for c in by], stats)[0, k])
            total += z
        return math.log10(total * stats["p_end"])

    assert got == pytest.approx({i: score(t) for i, t, _ in rows}, rel=1e-6)
