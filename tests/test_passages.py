"""Interval joins, exact references, text graphs and places against brute force and on hard rows."""

import random

from conftest import SF
from pyspark.sql import functions as F

from lexiquarry.operators import intervals, places, references
from lexiquarry.plans import registry
from lexiquarry.sources import text_graph


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_intervals(spark):
    rng = random.Random(5)
    span = lambda: (lo := rng.choice([rng.randrange(300), rng.randrange(1 << 40)]), lo + rng.choice([0, 1, 15, 16, 17, 400, 1 << 20, 1 << 45]))
    a = [(rng.choice("xy"), i, *span()) for i in range(150)] + [("x", 900, None, 5), ("x", 901, 9, 3), ("x", 902, -4, 3), (None, 903, 0, 9), ("x", 904, 0, (1 << 60) - 1)]
    b = [(rng.choice("xyz"), i, *span()) for i in range(150)] + [("x", 900, 1, None), ("x", 3, 0, 0), ("x", 3, 0, 0)]
    left, right = spark.createDataFrame(a, "k string, i int, lo long, hi long"), spark.createDataFrame(b, "k string, j int, f long, t long")
    good = lambda r: r[0] is not None and r[2] is not None and r[3] is not None and 0 <= r[2] <= r[3]
    pairs = [(p, q) for p in a for q in b if good(p) and good(q) and p[0] == q[0]]
    got = intervals.overlapping(left, right, ["k"], ("lo", "hi", "f", "t"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((p[1], q[1]) for p, q in pairs if p[2] <= q[3] and q[2] <= p[3])
    inside = intervals.within(left, right, ["k"], ("lo", "hi", "f", "t"))
    assert sorted((r["i"], r["j"]) for r in inside.collect()) == sorted((p[1], q[1]) for p, q in pairs if q[2] <= p[2] and p[3] <= q[3])
    assert intervals.overlapping(left.limit(0), right, ["k"], ("lo", "hi", "f", "t")).count() == 0


def test_references(spark):
    want = {
        "Genesis 4:16": [("genesis", 4, 16, 4, 16)], "1 Jn. 2:3-5, 9; 3:1–4:2; Exod 3": [("1 jn", 2, 3, 2, 5), ("1 jn", 2, 9, 2, 9), ("1 jn", 3, 1, 4, 2), ("exod", 3, 0, 3, None)],
        "Gen 1-2": [("gen", 1, 0, 2, None)], "Gen 5:3ff": [("gen", 5, 3, 5, None)], "GEN. 5:3f, 9a": [("gen", 5, 3, 5, 4), ("gen", 5, 9, 5, 9)], "Ps 3, 5-6": [("ps", 3, 0, 3, None), ("ps", 5, 0, 6, None)],
        "Gen 1-2:3": [("gen", 1, 0, 2, 3)], "; 3:4": [], "Gen 4:9-3": [], "xx 1:2 zz": [], "": [], None: [], "Song of Songs 1:2": [("song of songs", 1, 2, 1, 2)], "Gen 1:2 5": [("gen", 1, 2, 1, 2), ("gen", 1, 5, 1, 5)],
        "Jude": [("jude", 0, 0, None, None)], "3:1": [], "Gen 1:2-5:1, 7": [("gen", 1, 2, 5, 1), ("gen", 5, 7, 5, 7)], "Gen 1:99999999": [],
    }
    frame = spark.createDataFrame([(r,) for r in want], "reference string")
    got = {r: [] for r in want}
    c = references.CHAPTER
    for r in references.parsed(frame).orderBy("reference", "part", "lo").collect():
        (a, b), (x, y) = divmod(r["lo"], c), divmod(r["hi"], c)
        got[r["reference"]].append((r["book"], a, b, None if x == c - 1 else x, None if y == c - 1 else y))
    assert got == want
    books = spark.createDataFrame([("1 John", ["1 jn", "1 jhn"], 1), ("Genesis", ["gen"], 0), ("Other", ["gen"], 9), ("Bare", None, 3)], "name string, aliases array<string>, pos int")
    named = references.named(references.parsed(spark.createDataFrame([("1Jn 2:3",), ("gen 1:1",), ("bare 1:1",), ("who 1:1",)], "reference string")), books)
    assert sorted(r["book"] for r in named.collect()) == ["1 John", "Bare", "Genesis"]
    cited = references.cited(spark.createDataFrame([("See 1 Jn. 2:3, 5; 3:4 and Gen 4:16.",), (None,), ("none at 10",)], "text string"))
    assert [r["reference"] for r in cited.collect()] == ["1 Jn. 2:3, 5; 3:4", "Gen 4:16"]
    routes = references.routed(spark.createDataFrame([("Where is Nod?",), ("What does Gethsemane mean?",), ("what of Genesis 4:16",), ("love",), (None,)], "question string"))
    assert [(r["route"], r["about"]) for r in routes.collect()] == [("geography", "Nod"), ("meaning", "Gethsemane"), ("reference", "Genesis 4:16"), ("search", "love"), ("search", "")]


def test_no_pair_is_tried_in_vain(spark):
    plan = plan_of(registry.QUERIES["reference_overlaps"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tables_of_bins_are_not_broadcast_and_hold_few_rows(spark):
    """Spark doesn't see how much a table of bins is larger than its rows; and only levels that are homes have bins."""
    asked = registry.QUERIES["reference_overlaps"](spark, SF)
    assert not [x for x in plan_of(asked).splitlines() if "BroadcastHashJoin" in x and "_bin" in x]
    points = spark.range(1000).select(F.lit("x").alias("k"), "id", F.col("id").alias("lo"), F.col("id").alias("hi"))
    wide = spark.range(10).select(F.lit("x").alias("k"), F.col("id").alias("j"), (F.col("id") * 100).alias("f"), (F.col("id") * 100 + 99).alias("t"))
    for join in (intervals.overlapping, intervals.within):
        found = join(points, wide, ["k"], ("lo", "hi", "f", "t"))
        assert found.count() == 1000
        plan = plan_of(found)
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    looked = points.withColumn("_homes", intervals._homes(wide, "f", "t"))
    assert looked.first()["_homes"] == [1]


def test_text_graph_files(spark, tmp_path):
    """Numbers, ranges, lists and values alone, read whole and in many splits."""
    rng, want, lines, last = random.Random(1), [], ["@node", "@valueType=str", ""], 0
    for k in range(400):
        value = rng.choice(["", "a", "b\\tc", "x\\\\n", "d\\ne"])
        if rng.random() < 0.1:
            last += rng.randrange(1, 9)
            spec, nodes = rng.choice([(f"{last}", [(last, last)]), (f"{last}-{last + 3}", [(last, last + 3)]), (f"{last + 2}-{last + 1},{last + 6}", [(last + 1, last + 2), (last + 6, last + 6)])])
            last = max(hi for _, hi in nodes)
            lines.append(f"{spec}\t{value}")
        else:
            last += 1
            nodes = [(last, last)]
            lines.append(value)
        plain = value.replace("\\\\", "\0").replace("\\t", "\t").replace("\\n", "\n").replace("\0", "\\")
        want += [("full", lo, hi, plain) for lo, hi in nodes]
    (tmp_path / "full.tf").write_text("\n".join(lines) + "\n")
    (tmp_path / "head.tf").write_text("@node\n@only=header\n")
    (tmp_path / "none.tf").write_text("@node\n\n")
    whole = text_graph.values(text_graph.lines(spark, str(tmp_path)))
    assert sorted(map(tuple, whole.collect())) == sorted(want)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        parts = text_graph.lines(spark, str(tmp_path))
        assert parts.select("feature", "block").distinct().count() > 5
        assert sorted(map(tuple, text_graph.values(parts).collect())) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_graph(spark, tmp_path):
    """Two scrolls, one with a fragment in two places; a line of no fragment, one without text, and one that only seems to lie in a fragment."""
    files = {
        "otype": "@node\n\n1-12\tword\n20-25\tline\n30-31\tfragment\n40-41\tscroll\n", "oslots": "@edge\n\n20\t1-2\n21\t3-4\n5,6\n7-8\n9-10\n11-12\n30\t1-2,5-6\n31\t3-4,9\n40\t1-8\n9-12\n",
        "full": "@node\n\n" + "\n".join(f"w{k}" if k not in (7, 8) else "" for k in range(1, 13)) + "\n", "after": "@node\n\n1-6\t \n9-12\t_\n", "name": "@node\n\n20-25\tL\n30\tf1\nf2\n40\tS1\nS2\n",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.tf").write_text(data)
    found = text_graph.values(text_graph.lines(spark, str(tmp_path))).cache()
    nodes, slots = text_graph.nodes(found), text_graph.slots(found)
    pairs = lambda a, b: sorted((r["outer"], r["inner"]) for r in text_graph.contained(nodes, slots, a, b).collect())
    assert pairs("scroll", "line") == [(40, 20), (40, 21), (40, 22), (40, 23), (41, 24), (41, 25)]
    assert pairs("fragment", "line") == [(30, 20), (30, 22), (31, 21)] and pairs("line", "line") == [] and pairs("scroll", "fragment") == [(40, 30)]
    words = text_graph.feature(found, "full").join(text_graph.feature(found, "after"), "node", "left")
    texts = text_graph.line_texts(nodes, slots, words)
    assert {r["node"]: r["text"] for r in texts.collect()} == {20: "w1 w2", 21: "w3 w4", 22: "w5 w6", 23: "", 24: "w9_w10_", 25: "w11_w12_"}
    got = text_graph.manuscript(nodes, slots, texts, text_graph.feature(found, "name")).orderBy("scroll", "chapter", "passage").collect()
    assert [tuple(r) for r in got] == [("S1", 1, 1, "f1", "L", "w1 w2"), ("S1", 2, 1, "f2", "L", "w3 w4"), ("S1", 3, 1, "f1", "L", "w5 w6"), ("S2", 1, 1, "1", "L", "w9_w10_"), ("S2", 1, 2, "1", "L", "w11_w12_")]
    # words as runs, one of them across lines and fragments, give the same, and none of them is shuffled alone
    is_word = F.col("otype") == "word"
    kept = nodes.filter(~is_word)
    runs = spark.createDataFrame([("word", 1, 1, 7), ("word", 8, 8, 12)], "otype string, node long, lo long, hi long")
    for a, b in (("fragment", "word"), ("scroll", "word"), ("scroll", "line"), ("word", "word"), ("word", "line")):
        split = text_graph.contained(kept, slots.join(kept, "node", "left_semi"), a, b, runs=runs)
        assert sorted((r["outer"], r["inner"]) for r in split.collect()) == pairs(a, b)
    said = {k: ("" if k in (7, 8) else f"w{k}") + (" " if k < 7 else "_" if k > 8 else "") for k in range(1, 13)}
    packed = spark.createDataFrame([(1, 1, 7, [said[k] for k in range(1, 8)]), (8, 8, 12, [said[k] for k in range(8, 13)])], "node long, lo long, hi long, said array<string>")
    again = text_graph.run_texts(kept, slots.join(kept, "node", "left_semi"), packed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, texts.collect()))
    found.unpersist()


def test_graph_queries_shuffle_no_row_a_word(spark):
    """Words stay runs until they come out."""
    for name in ("graph_descent", "graph_manuscripts"):
        assert "posexplode(words" not in plan_of(registry.QUERIES[name](spark, SF))


def test_places(spark):
    rng = random.Random(3)
    names = ["a", "a b", "a b c d", "b c", "c d e", "É f", "", "!!", "a b"]
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", None, "A, b! C", "é F", "a " * 3000]
    gaz = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place_id int, name string")
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, prefix string")
    known = {tuple(n.lower().split()) for n in names if n.strip("! ")}
    want = []
    for i, t in enumerate(texts):
        w, at = ["".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split()], 0
        while at < len(w):
            size = max((n for n in range(1, 5) if at + n <= len(w) and tuple(w[at : at + n]) in known), default=0)
            if size:
                want.append((i, at, size, " ".join(w[at : at + size])))
            at += max(size, 1)
    found = places.mentions(frame, gaz, ["id"])
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 3000
    both = places.identified(found.filter("phrase = 'a b'"), gaz)
    assert {r["place_id"] for r in both.collect()} == {1, 8}
    assert places.mentions(frame, gaz.limit(0), ["id"]).count() == 0 and places.mentions(frame.limit(0), gaz, ["id"]).count() == 0
    asked = places.asked(spark.createDataFrame([("geography", "the A  b"), ("search", "a b"), ("meaning", "c")], "route string, about string"), gaz)
    assert sorted((r["about"], r["place_id"]) for r in asked.collect()) == [("the A  b", 1), ("the A  b", 8)]
