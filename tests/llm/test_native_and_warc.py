"""URL filters, WARC archives, mixing and quality rules on hard rows."""

import datetime
import hashlib
import random
from base64 import b32encode
from math import comb

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import common, mixing, quality_rules, url_filters, warc

PAGES = "page_id long, url string, html string, payload string"
DOCS = "doc_id long, text string, lang string, source string, n_words long, size long"


def day(k):
    return datetime.date(2024, 1, k)


def test_url_lists(spark):
    entries = spark.createDataFrame([("Bad.com", "block", day(5)), ("bad.com", "allow", day(10)), ("ok.bad.com", "allow", day(6)), ("bad.com/x", "block", day(11)), ("tie.org", "block", day(1)), ("tie.org", "allow", day(1)), (None, "block", day(1)), ("n.com", None, day(1))], "pattern string, action string, listed date")
    rows = [("http://www.BAD.com/a", 4, False), ("http://www.BAD.com/a", 5, True), ("http://bad.com:80/?q", 9, True), ("https://bad.com", 10, False), ("http://ok.bad.com/", 7, False), ("http://u@bad.com/x/y#z", 12, True), ("http://bad.com/xy", 12, False), ("http://notbad.com", 6, False), ("http://tie.org", 2, False), (None, 6, False), ("nonsense", 6, False), ("", 6, False)]
    frame = spark.createDataFrame([(i, u, day(d), "clash") for i, (u, d, _) in enumerate(rows)] + [(99, "http://bad.com", None, "clash")], "id long, url string, fetched date, pattern string")
    got = {r["id"]: r for r in url_filters.decided(frame, entries).collect()}
    assert [got[i]["url_blocked"] for i in range(len(rows))] == [w for _, _, w in rows] and got[99]["url_blocked"] is False
    assert got[5]["url_pattern"] == "bad.com/x" and got[0]["pattern"] == "clash"
    assert url_filters.decided(frame.limit(0), entries).count() == 0 and not any(r["url_blocked"] for r in url_filters.decided(frame, entries.limit(0)).collect())
    assert url_filters.keep(frame, entries).columns == frame.columns


def test_url_list_paths_keep_their_case(spark):
    entries = spark.createDataFrame([("Bad.com/Ads", "block", day(1)), ("bad.COM/ads", "allow", day(1)), ("ok.org/X/y", "block", day(1))], "pattern string, action string, listed date")
    rows = [("http://bad.com/Ads/x", "block"), ("http://BAD.com/Ads", "block"), ("http://bad.com/ads", "allow"), ("http://bad.com/ADS", None), ("http://ok.org/X/y/z", "block"), ("http://ok.org/x/y", None)]
    frame = spark.createDataFrame([(i, u, day(2)) for i, (u, _) in enumerate(rows)], "id long, url string, fetched date")
    got = {r["id"]: r["url_action"] for r in url_filters.decided(frame, entries).collect()}
    assert got == {i: a for i, (_, a) in enumerate(rows)}
    clash = url_filters.decided(frame.selectExpr("*", "1 AS best", "2 AS row", "3 AS spans", "4 AS labels", "5 AS n"), entries)
    assert {r["id"]: (r["url_action"], r["best"], r["n"]) for r in clash.collect()} == {i: (a, 1, 5) for i, (_, a) in enumerate(rows)}
    deep = spark.createDataFrame([(0, "http://bad.com/Ads/" + "x/" * 20_000, day(2))], frame.schema)
    assert url_filters.decided(deep, entries).first()["url_action"] == "block"


def test_warc(spark, tmp_path):
    body = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx"
    rows = [(11, "u", "x\r\n", "p"), (12, "u", "\r\n\r\n\r\n", "p"), (13, "u", "y\r\n\r\n", "p"), (1, "http://a", body, "p"), (7, "http://b\r\nX: 1", body, "p"), (3, None, "", "p"), (4, "u", None, "p"), (5, "u", "é\n", "p"), (6, "u", "x" * 100_000, "p"), (None, "u", body, "p"), (5, "u", "é\n", "p")]
    frame = spark.createDataFrame(rows, PAGES)
    path = common.scratch(spark, "test")
    warc.write_archives(warc.resolve(frame), path, file_records=3)
    full = warc.read_archives(spark, path).collect()
    assert sorted(r["payload"] for r in full if r["record_type"] == "response") == sorted([body, "", "é\n", "é\n", "x" * 100_000, "x\r\n", "\r\n\r\n\r\n", "y\r\n\r\n"])
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolved_archives(spark, path).collect())
    digest = lambda t: b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = []
    for i, _, h, _ in rows:
        h = h or ""
        top = max((k for k, _, x, _ in rows if (x or "") == h and k is not None))
        want.append((str(i), len(h.encode()), digest(h), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want)
    first = warc.resolve(frame, min_bytes=1000).filter("page_id in (1, 7)").select("record_type").distinct().collect()
    assert [r[0] for r in first] == ["response"]
    empty = common.scratch(spark, "test")
    warc.write_archives(warc.resolve(frame.limit(0)), empty)
    assert warc.resolved_archives(spark, empty).count() == 0


def test_records_of_parts():
    """Whatever line ends the blocks hold, the parts between double line ends give the records back."""
    rng = random.Random(2)
    for _ in range(300):
        blocks = [b"".join(rng.choice([b"\r\n", b"\r\n\r\n", b"a", b"WARC/1.1\r\n", b"\n", b"\r"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 6))]
        data = b"".join(b"WARC/1.1\r\nN: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(x), x) for k, x in enumerate(blocks))
        parts = data.split(b"\r\n\r\n")
        reader, got = warc.Records("f"), []
        for part in parts[:-1] if not parts[-1] else parts:
            got += reader.part(part)
        reader.end()
        assert [(int(h[b"n"]), x) for h, x in got] == list(enumerate(blocks))
    cut_short = warc.Records("f")
    assert cut_short.part(b"WARC/1.1\r\nContent-Length: 9") == [] and cut_short.part(b"ab") == []
    with pytest.raises(ValueError, match="has no end"):
        cut_short.end()


def test_mixing(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 3}", 0, 0) for i in range(300)] + [(1000 + i, "w", "en", None, 0, 0) for i in range(10)] + [(2000, None, "en", "empty", 0, 0), (None, "a b", "en", "s0", 0, 0), (5, "w " * 10, "en", "s2", 0, 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.with_copies(frame).collect()
    assert got[0]["size"] == 0 and len(got) == len(rows)  # the clashing column stays
    size, target, taken = {}, {}, {}
    for r in got:
        s = r["source"]
        size[s], target[s] = r["mix_source_size"], r["mix_target"]
        taken[s] = taken.get(s, 0) + r["mix_copies"] * r["mix_size"]
        assert r["mix_copies"] <= 3
    total = sum(size.values())
    # water-filling by hand: weights by code point, null last
    weights = {s: w for s, w in zip(["empty", "s0", "s1", "s2", None], [1, 2, 3, 1, 2])}
    capped: set = set()
    while True:
        free = total - sum(3 * size[s] for s in capped)
        share = {s: free * w / sum(w for t, w in weights.items() if t not in capped) for s, w in weights.items() if s not in capped}
        more = {s for s, x in share.items() if x >= 3 * size[s]}
        if not more:
            break
        capped |= more
    want = share | {s: 3 * size[s] for s in capped}
    for s in weights:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.35 * target[s] + 60
    assert sorted(map(str, mixing.mix(frame).collect())) == sorted(map(str, mixing.mix(frame).collect()))
    assert mixing.mix(frame).count() == sum(r["mix_copies"] for r in got) and mixing.mix(frame).columns == frame.columns
    assert mixing.mix(frame.limit(0)).count() == 0


def test_lookup_join_paths(spark):
    left = spark.createDataFrame([(k if k % 3 else 7, k) for k in range(3000)], "key int, v int")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key < 1500").withColumn("w", F.col("key") * 2).cache()
    small, large = (sorted(map(str, common.lookup_join(left, right, "key", "n", small=s).collect())) for s in (10_000, 0))
    assert small == large and len(small) == 3000


def _counts(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hot = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hot)


def test_quality_counts(spark):
    texts = [None, "", " \n ", "a b c a b c", "a b c d a b c d", "a a a a", "x\nx\n\n \nx", "é ß  | < \t#*$%&> \x0b", "one two", "w " * 500, "日本 語", "\x1c\x85 a"]
    frame = spark.createDataFrame([(i, t, None, None, 5, 6) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in quality_rules.with_features(frame).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i]["q_" + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _counts(t), repr(t)
        assert got[i]["n_words"] == 5


def test_binomial_bound(spark):
    def cdf(n, p, k):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n in (0, 10, 300, 1000):
        for p in (0.004, 0.05):
            k = spark.range(1).select(quality_rules.most_rejected(F.lit(n).cast("long"), p, F.lit(0.01))).first()[0]
            assert (k == -1 or cdf(n, p, k) <= 0.01) and (k + 1 > n * p or cdf(n, p, k + 1) > 0.01)


def test_quality_cutoffs_hold(spark):
    """Junk that the base rule lets pass goes by the cutoffs; junk that it doesn't goes without any."""
    good = "word " * 3 + " ".join(f"w{i}" for i in range(60))
    marks = " " + " ".join(f"#{i}!!" for i in range(60))
    rows = [(i, good, "en" if i % 2 else None, "s", 0, 0) for i in range(6000)] + [(10_000 + i, good + marks, "en", "s", 0, 0) for i in range(50)] + [(20_000 + i, good + " ***" * 90, "en", "s", 0, 0) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(6000)] + [(10_000 + i, 0) for i in range(50)] + [(None, 1), (1, 1), (77, None), (-5, 1)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in quality_rules.keep(frame, labels).collect()}
    assert kept == set(range(6000))
    failed = {r["doc_id"] for r in quality_rules.with_features(frame).filter("q_base_failed").collect()}
    assert failed == {20_000 + i for i in range(50)}  # so the cutoffs reject the others
    assert quality_rules.keep(frame.limit(0), labels).count() == 0 and quality_rules.keep(frame, labels.limit(0)).count() == 6050


def test_quality_cutoffs_share_the_bound(spark):
    """217 good rows are enough for a language of four, whatever others without good rows there are; a step that rejects good rows ends the test for all rules."""
    good = " ".join(f"w{i}" for i in range(100))
    good_rows = {lang: [(1000 * k + i, good + ("!" * 35 if lang == "d" and i < 9 else ""), lang, "s", 0, 0) for i in range(n)] for k, (lang, n) in enumerate([("a", 217), ("b", 216), ("c", 217), ("d", 217)])}
    bad = [(10_000 + k, good + " #!" * 60, lang, "s", 0, 0) for k, lang in enumerate("abcdefg")]
    labels = spark.createDataFrame([(r[0], 1) for rows in good_rows.values() for r in rows], "doc_id long, quality int")
    features = common.stash(quality_rules.with_features(spark.createDataFrame([*sum(good_rows.values(), []), *bad], DOCS)), "features")
    cuts = {r["stratum"]: r for r in quality_rules.cutoffs(features, labels).collect()}
    strict = {"cut_" + rule: cs[-1] for rule, cs in quality_rules.RULES.items()}
    for lang in "ac":
        assert {c: cuts["=" + lang][c] for c in strict} == strict
    for lang in "befg":
        assert all(cuts["=" + lang][c] is None for c in strict)
    assert cuts["=d"]["cut_bangs"] == 0.4 and cuts["=d"]["cut_upper"] == 0.4 and cuts["=d"]["cut_symbols"] == 0.3
    kept = {r["doc_id"] for r in quality_rules.judged(features, labels).filter("q_kept").collect()}
    assert {i - 10_000 for i in kept if i >= 10_000} == {1, 4, 5, 6} and len(kept) == 867 + 4
