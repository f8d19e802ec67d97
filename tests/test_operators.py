"""Operators on small fixtures, against plain Python where SQL can't say the same."""

import base64
import gzip
import json
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from lexiquarry.functions import features, hashing, text, udfs
from lexiquarry.operators import align, blocks, catalog, crossrefs, hierarchy, repair, search, state, validate
from lexiquarry.sources import books, state_store


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokenizers_differ(spark):
    s = F.lit("Don't a I 42, naïve Ωmega -- x")
    got = one(spark, text.search_tokens(s), text.concordance_words(s), text.diff_tokens(F.lit("It's, ok...")), text.query_terms(F.lit("The THE quick quick fox and there a")))
    assert got[0] == ["don't", "42", "naïve", "ωmega"]
    assert got[1] == ["Don't", "a", "I", "42", "naïve", "Ωmega", "x"]
    assert got[2] == ["It's", ",", "ok", "..."]
    assert got[3] == ["quick", "fox"]


def test_normalisers(spark):
    assert one(spark, text.word_norm(F.lit("O'Neil’s-2")), text.name_norm(F.lit(" 1st  John’s ")), text.compact(F.lit("  a \t\n b ")), text.reference_norm(F.lit("Gen.  1:1 "))) == ("oneils2", "1st john s", "a b", "gen 1:1")
    folded = one(spark, text.identity_of_folded(udfs.nfkd_fold(F.lit("The First Épistle of Saint Peter"))), text.identity_of_folded(udfs.nfkd_fold(F.lit("Σοφία"))))
    assert folded == ("peter", "")
    assert "1 jhn" in one(spark, text.aliases(F.lit("1 John"), F.lit("1JN")))[0]
    assert one(spark, text.citation(F.lit("T"), F.lit(""), F.lit("Chapter 1"), F.lit("2"), "L"))[0] == "T. Chapter 1:2. L."
    assert one(spark, text.strong_keys(F.lit("g 03056")))[0].asDict() == {"letter": "G", "plain": "G3056", "padded": "G3056"}
    assert one(spark, text.strong_keys(F.lit("g12x")))[0] is None
    assert one(spark, text.title_label(F.lit("aB-c_d o'neil (x) a.b éa " + "w" * 1_000_003)), text.url_path(F.lit("a b/é")), text.html_escape(F.lit("<a'>"))) == ("AB C D O'Neil (X) A.B éA W" + "w" * 1_000_002, "a%20b/%C3%A9", "&lt;a&#39;&gt;")


def test_hashes(spark):
    assert one(spark, hashing.fnv1a(F.lit("god")), hashing.times33(F.lit("god")), hashing.base36(F.lit(1209769725))) == (1209769725, 193412201, "k09kal")
    def fold(units):
        a, b = hashing.FNV_OFFSET, hashing.SEED33
        for u in units:
            a, b = ((a ^ u) * hashing.FNV_PRIME) % 2**32, (b * 33) % 2**32 ^ u
        return a, b

    for word in ("", "naïve", "日本", "a🙂b"):
        data = word.encode("utf-16-be")
        assert one(spark, hashing.fnv1a(F.lit(word)), hashing.times33(F.lit(word))) == fold([data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)])


def test_bloom_never_misses(spark):
    rows = spark.createDataFrame([(k, f"word{k} common tail{k % 7}") for k in range(300)], "work_index long, text string")
    filters = search.bloom_filters(search.shard_tokens(rows, shards=16))
    for query in ("word17", "tail3 common", "absent"):
        allowed = {r["shard"] for r in search.shards_for(filters, query).collect()}
        assert {r["work_index"] % 16 for r in search.matches_all(rows, query).collect()} <= allowed
    assert len(search.shards_for(filters, "absent").collect()) < 4


def test_search_guards(spark):
    rows = spark.createDataFrame([(1, "the cat"), (2, None), (3, "cats the")], "id long, text string")
    assert [r["id"] for r in search.search_all_terms(rows, "CAT the", ["id"]).collect()] == [1]
    assert search.search_all_terms(rows, "c", ["id"]).count() == 0
    assert search.concordance_hits(rows, "...").count() == 0
    assert search.retrieve(rows, "the of", ["id"]).count() == 0


def test_word_diff_by_table(spark):
    def lcs(a, b):
        t = {}
        for i in reversed(range(len(a) + 1)):
            for j in reversed(range(len(b) + 1)):
                t[i, j] = 0 if i == len(a) or j == len(b) else t[i + 1, j + 1] + 1 if a[i] == b[j] else max(t[i + 1, j], t[i, j + 1])
        return t[0, 0]

    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        left, right = udfs.kept_tokens(a, b)
        assert sum(left) == lcs(a, b) == sum(right) and [w for w, k in zip(a, left) if k] == [w for w, k in zip(b, right) if k]
    # on a tie the right side's tokens are passed over first
    assert [x.tolist() for x in udfs.kept_tokens(["a", "b"], ["b", "a"])] == [[True, False], [False, True]]
    assert not udfs.kept_tokens([","], [","])[0].any() and udfs.kept_tokens(["A-b"], ["ab"])[0].all()
    rows = spark.createDataFrame([(["a"] * 251, ["A", ","]), (None, [])], "l array<string>, r array<string>").select(udfs.word_diff("l", "r").alias("d")).collect()
    assert rows[0]["d"]["cut"] and len(rows[0]["d"]["left"]) == 250 and [tuple(x) for x in rows[0]["d"]["right"]] == [("A", True), (",", False)] and rows[1]["d"]["left"] == []


def test_kept_tokens_in_blocks():
    """Rows that are made twice, and the plain table walked from the front, mark the same tokens."""

    def walked(a, b):
        rest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                rest[i][j] = rest[i + 1][j + 1] + 1 if a[i] == b[j] != "," else max(rest[i + 1][j], rest[i][j + 1])
        i, j, marks = 0, 0, ([False] * len(a), [False] * len(b))
        while i < len(a) and j < len(b):
            if a[i] == b[j] != ",":
                marks[0][i] = marks[1][j] = True
                i, j = i + 1, j + 1
            elif rest[i][j + 1] >= rest[i + 1][j]:
                j += 1
            else:
                i += 1
        return marks

    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcdef,") for _ in range(rng.choice([0, 1, 9, 90]))] for _ in range(2))
        for most in (1, 40, udfs.ROWS_BYTES):
            assert tuple(x.tolist() for x in udfs.kept_tokens(a, b, most)) == walked(a, b)


def test_diff_numbers_words_by_batch():
    """Slices, nulls and empty sides of Arrow's columns have the marks of kept_tokens."""
    rng = random.Random(5)
    rows = [[None if rng.random() < 0.1 else [rng.choice(["a", "A", "É", "é", "b-", "b", ","]) for _ in range(rng.randrange(7))] for _ in range(90)] for _ in range(2)]
    left, right = (pa.array(side, pa.list_(pa.string())).slice(20, 60) for side in rows)
    for a, b, got in zip(rows[0][20:80], rows[1][20:80], udfs._diff(left, right).to_pylist()):
        want = [[{"token": w, "kept": bool(k)} for w, k in zip(side, marks)] for side, marks in zip((a or [], b or []), udfs.kept_tokens(a or [], b or []))]
        assert [got["left"], got["right"]] == want and not got["cut"]


def test_word_diff_hands_over_no_more_than_it_marks(spark):
    """Tokens beyond the marked ones stay in the JVM, and Arrow's columns take the place of Python's rows."""
    rows = spark.createDataFrame([(["a"] * 9000, ["A", ","]), (None, None), ([], ["b"]), (["x", "é"], ["É"])], "l array<string>, r array<string>")
    marked = rows.select("l", udfs.word_diff("l", "r").alias("d"))
    assert "slice(l#" in marked._jdf.queryExecution().optimizedPlan().toString()
    got = [([(x["token"], x["kept"]) for x in r["d"]["left"]], [(x["token"], x["kept"]) for x in r["d"]["right"]], r["d"]["cut"]) for r in marked.collect()]
    assert got == [([("a", True)] + [("a", False)] * 249, [("A", True), (",", False)], True), ([], [], False), ([], [("b", False)], False), ([("x", False), ("é", True)], [("É", True)], False)]


def test_plain_lines_of_many_texts(spark):
    """More texts than are Python's at a time; no pandas column holds them all."""
    assert udfs.plain_lines.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else f"\ufeff&amp;{k}\r\n\r") for k in range(250)], "k int, t string").coalesce(1)
    assert [r[0] for r in rows.select(udfs.plain_lines("t")).collect()] == [None if k % 7 == 0 else f"&{k}\n\n" for k in range(250)]


def _aligned(p, s):
    """The rules of alignment, step by step."""
    where = {}
    for k, (label, _) in enumerate(s):
        where.setdefault(label or str(k + 1), k)
    out, used = [], set()
    for k, (label, _) in enumerate(p):
        label = label or str(k + 1)
        hit = where.get(label, k if k < len(s) else None)
        used.add(hit)
        out.append((label, k, hit))
    return out + [(label or str(k + 1), None, k) for k, (label, _) in enumerate(s) if k not in used]


def test_alignment(spark):
    rng = random.Random(5)
    ps, ss, want = [], [], []
    for g in range(60):
        side = lambda: [(rng.choice(["1", "2", "3", "x", None]), "t") for _ in range(rng.randrange(5))]
        p, s = side(), side()
        ps += [(g, k, a, b) for k, (a, b) in enumerate(p)]
        ss += [(g, k, a, b) for k, (a, b) in enumerate(s)]
        want += [(g, *row) for row in _aligned(p, s)]
    schema = "g long, idx long, label string, text string"
    got = align.align(spark.createDataFrame(ps, schema), spark.createDataFrame(ss, schema), ["g"]).select("g", "label", "primary_index", "secondary_index").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_backlinks(spark):
    refs = spark.createDataFrame([("John 1:1",), ("John 1:1-3",), ("John 1:10",), ("John 1:1,4",), ("Joh 1:1",), ("John 1:0-1",)], "reference string")
    got = crossrefs.backlinks(refs, spark.createDataFrame([("john 1:1",)], "target string")).collect()
    assert sorted(r["reference"] for r in got) == ["John 1:1", "John 1:1,4", "John 1:1-3"]


def test_txt_import(spark):
    doc = "Intro\r\n\r\nmore\r\nlines\n\nChapter One\n\nSection Two\n\nbody\n\nCHAPTER three"
    got = blocks.txt_import(spark.createDataFrame([(1, doc), (2, ""), (3, None)], "k long, text string"), "k").orderBy("chapter", "passage").collect()
    assert [(r["k"], r["chapter"], r["chapter_label"], r["passage"], r["text"]) for r in got] == [(1, 1, "Chapter 1", 1, "Intro"), (1, 1, "Chapter 1", 2, "more lines"), (1, 2, "Section Two", 1, "body")]


def test_bracketed_and_merged(spark):
    lines = blocks.lines_of(spark.createDataFrame([(1, "[1:1] In\n\n[1:2]  the")], "k long, text string"), "k")
    assert [(r["chapter"], r["verse"], r["text"]) for r in blocks.bracketed(lines, "k").orderBy("line_no").collect()] == [("1", "1", "In"), ("1", "2", "the")]
    bad = blocks.lines_of(spark.createDataFrame([(1, "no bracket")], "k long, text string"), "k")
    with pytest.raises(Exception, match="not a bracketed line"):
        blocks.bracketed(bad, "k").collect()
    sections = spark.createDataFrame([("w", 1, 0, ["a", "b"]), ("w", 2, 1, ["c"]), ("w", 1, 2, ["d"]), ("w", 3, 3, [])], "k string, number int, pos int, segments array<string>")
    assert [(r["number"], r["label"], r["segment"]) for r in blocks.merged_headings(sections, "k", "number", "pos").orderBy("number", "label").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    nodes = spark.createDataFrame([(1, "scroll", None, "S", 0), (2, "scroll", None, "T", 1), (3, "line", 1, "l1", 0), (4, "line", 2, "l2", 0)], "id int, kind string, parent_id int, name string, pos int")
    assert [r["name"] for r in blocks.contained(nodes, spark.createDataFrame([("S",)], "name string"), "scroll", "line").collect()] == ["l1"]


def test_repair(spark):
    rows = spark.createDataFrame([(1, "HALAKHAH: 25For all.26Next written1972K. 19:3"), (2, "see fol. 12 of it"), (3, None), (4, "the Eterna1153Num. 31:50")], "k long, text string")
    got = {r["k"]: r for r in repair.repair(rows).collect()}
    assert "[25] For" in got[1]["repaired"] and ". [26] Next" in got[1]["repaired"] and got[1]["left_over"] == 0
    assert not got[2]["changed"] and got[3]["repaired"] == "" and "153" in got[4]["repaired"]


def test_scanner():
    assert json.loads(udfs.assigned_value('<script>window.X = {"a": "}\\"{", "b": [1, {}]};window.Y=1</script>', "X")) == {"a": '}"{', "b": [1, {}]}
    assert json.loads(udfs.assigned_value('window.S="a\\"b";', "S")) == 'a"b'
    assert json.loads(udfs.assigned_value("window.S='é\\'\\u00e9\\n';", "S")) == "é'é\n"
    assert udfs.assigned_value("window.Z=1", "X") is None
    with pytest.raises(ValueError):
        udfs.assigned_value('window.X={"a":1', "X")


def test_embedded_says_what_is_wrong(spark):
    pages = spark.createDataFrame([(1, 'window.X={"a":1};'), (2, "nothing"), (3, 'window.X={"a":1'), (4, None), (5, "window.X={a:1}")], "k int, html string")
    got = {r["k"]: r for r in books.embedded(pages, "k", "X").withColumn("value", F.to_json("value")).collect()}
    assert got[1]["value"] == '{"a":1}' and got[1]["problem"] is None
    assert all(got[k]["value"] is None and got[k]["problem"] for k in (2, 3, 4, 5))
    # a page at a time: of several bad ones, any may be the first to fail
    for k, problem in ((2, "nothing is assigned to X"), (3, "has no end"), (4, "nothing is assigned to X"), (5, "isn't JSON")):
        with pytest.raises(Exception, match=problem):
            books.embedded_or_fail(pages.filter(F.col("k") == k), "k", "X").collect()
    assert books.embedded_or_fail(pages.filter("k = 1"), "k", "X").count() == 1


def test_zipped(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "one")
        z.writestr("y.txt", "two")
    got = books.read_zipped(spark, str(tmp_path)).collect()
    assert [(r["member"], bytes(r["content"])) for r in got] == [("d/x.txt", b"one"), ("y.txt", b"two")]


def test_payloads(spark, tmp_path):
    payload = {"edition": {"id": "e"}, "book": {"id": "B"}, "chapters": {"10": [{"v": "1", "text": "ten"}], "2": [{"text": "two"}, {"v": "9", "label": "b", "text": "x"}], "A": [{"v": "1", "text": "a"}]}}
    (tmp_path / "B.json.gz").write_bytes(gzip.compress(json.dumps(payload).encode()))
    got = books.segments_of(books.read_payloads(spark, str(tmp_path))).orderBy("chapter_ord", "seg_idx").collect()
    assert [(r["chapter"], r["seg_idx"], r["label"]) for r in got] == [("2", 0, "1"), ("2", 1, "b"), ("10", 0, "1"), ("A", 0, "1")]
    (tmp_path / "z.bin").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "p.bin").write_bytes(b"plain")
    assert sorted(r["content"] for r in books.read_maybe_gzip(spark, str(tmp_path), "*.bin").collect()) == ["packed", "plain"]
    packed = spark.createDataFrame([("k", base64.b64encode(gzip.compress(b'{"a":1}')).decode())], "k string, b string")
    assert books.packed(packed, "k", "b").first()["content"] == '{"a":1}'


def test_json_import(spark):
    rows = [("a", json.dumps({"title": "T", "chapters": {"1": ["x", {"text": " y "}, " ", {"label": "9", "value": "z"}, {"v": 7, "text": "w"}, None, 5, {"text": " "}]}})), ("b", json.dumps({"book": {"name": "N", "chapters": {"1": ["q"]}}})), ("c", "broken")]
    got = books.json_import(spark.createDataFrame(rows, "k string, content string"), "k").orderBy("k", "label").collect()
    assert [(r["k"], r["title"], r["label"], r["text"]) for r in got] == [("a", "T", "1", "x"), ("a", "T", "2", "y"), ("a", "T", "3", " "), ("a", "T", "7", "w"), ("a", "T", "9", "z"), ("b", "N", "1", "q")]


def test_state(spark):
    log = spark.createDataFrame([(k, 1, "w", k // 2) for k in range(250)], "event_id long, user_id long, work string, passage long").withColumn("ts", F.timestamp_seconds("event_id"))
    h = state.history(log, ["user_id"], ["work", "passage"]).orderBy("place").collect()
    assert len(h) == 100 and h[0]["passage"] == 124
    snap = state_store.parse_snapshot(spark.createDataFrame([('{"notes":{"a":"b"},"junk":1}',), ("broken",)], "value string")).collect()
    assert snap[0]["state"]["notes"] == {"a": "b"} and snap[1]["state"]["notes"] == {} and snap[1]["state"]["version"] == 2
    chapters = spark.createDataFrame([("w", "1", 0), ("w", "2", 1)], "work_key string, chapter string, chapter_ord int")
    assert [state.chapter_or_first(chapters, "w", a, b).first()["chapter"] for a, b in (("2", None), (None, "2"), ("9", None), (None, None))] == ["2", "2", "1", "1"]


def test_removed_imports(spark):
    """What the reader's store leaves after the same clicks."""
    cases = {
        "click, import, remove, import": [], "click, remove, import, click": [], "import, click, remove, click": ["on"], "click, import, remove, remove, click": ["on"],
        "click, remove": ["on"], "import, remove, click, click, click": ["on"],
    }
    kinds = {"click": "click", "import": "import", "remove": "remove-import"}
    rows = [(k * 100 + i, k, "w", kinds[x]) for k, case in enumerate(cases) for i, x in enumerate(case.split(", "))]
    log = spark.createDataFrame(rows, "event_id long, user_id long, work string, kind string").withColumn("ts", F.timestamp_seconds("event_id"))
    events = state.since_removal(log, state.removals(log, ["user_id"]), ["user_id"])
    on = {r["user_id"] for r in state.toggles(events.filter("kind = 'click'"), ["user_id", "work"]).collect()}
    # in the second case nothing was imported when the removal came, so both clicks count
    assert on == {k for k, want in enumerate(cases.values()) if want}


def test_saved_generations(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        state_store.load(spark, path)
    for k in range(2):
        state_store.save(spark.createDataFrame([(k,)], "k int"), path)
    (tmp_path / "s" / "generation=7").mkdir()  # a writer that died
    assert state_store.load(spark, path).collect()[0]["k"] == 1
    state_store.save(state_store.load(spark, path).selectExpr("k + 1 AS k"), path)
    assert state_store.load(spark, path).collect()[0]["k"] == 2
    snap = state_store.parse_snapshot(spark.createDataFrame([('{"notes":{"a":"b"}}',)], "value string"))
    assert json.loads(state_store.exported(snap).first()["exported"])["notes"] == {"a": "b"}
    assert state_store.cleared(snap).first()["state"]["notes"] == {}


def test_collection_items(spark):
    rows = spark.createDataFrame([("c", None, "w", "1", None, None, "x"), ("c", "note", "w", "1", "", "", "y")], "id string, type string, work string, chapter string, passage string, source string, text string")
    keyed = rows.select("id", *state.item_key(), "text")
    new = spark.createDataFrame([("c", "passage", "w", "1", "", None, "z")], rows.schema).select("id", *state.item_key(), "text")
    assert sorted(r["text"] for r in state.replaced(keyed, new, ["id", "type", "work", "chapter", "passage", "source"]).collect()) == ["y", "z"]


def test_first_bytes(spark):
    s = "aé日🙂b"
    for n in range(len(s.encode()) + 2):
        assert one(spark, text.first_bytes(F.lit(s), F.lit(n)))[0] == s.encode()[:n].decode(errors="ignore")


def test_features():
    assert features.any_on(features.switches()) and not features.any_on(features.switches(features.FEATURES))
    assert [k for k, on in features.switches(("concordance",)).items() if not on] == ["concordance"]
    with pytest.raises(ValueError):
        features.switches(("nope",))


def test_validation(spark):
    clean = spark.createDataFrame([("a/b", "local-readable", "p", None)], "key string, content_state string, reader_path string, source_url string")
    assert validate.verdict(validate.report(validate.work_rules(clean, clean.select("key")))).first()["result"] == "PASS"
    bad = spark.createDataFrame([("a", "odd", None, None), ("b", "local-readable", None, None), ("c", "source-readable", None, "ftp://x"), ("c", "source-readable", None, "http://x"), ("d", "bibliographic", "p", None)], clean.schema)
    rules = {r["rule"] for r in validate.report(validate.work_rules(bad, bad.filter("key = 'b'").select("key"))).collect()}
    assert rules == {"unique-key", "state-domain", "readable-has-payload", "others-have-none", "source-url"}
    files, listed = (spark.createDataFrame(rows, "key string, sha256 string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert sorted(r["subject"] for r in validate.wrong_digests(files, listed).collect()) == ["b", "c"]
    with pytest.raises(Exception, match="unsafe work key"):
        spark.range(1).select(text.safe_key(F.lit("a/b c"))).collect()


def test_hierarchy_kjv_canon(spark):
    groups = hierarchy.group_table(spark, [("restoration", "g", ["kjv"])])
    rows = [(f"k{i}", i, "kjv", "t", None, n, n, None, "local-readable") for i, n in enumerate(("Genesis", "Tobit", "Jude"))]
    works = spark.createDataFrame(rows, "key string, work_index long, edition_id string, edition_title string, collection_label string, title string, name string, section string, content_state string")
    assert sorted(r["key"] for r in hierarchy.records(works, groups, "restoration", "g").collect()) == ["k0", "k2"]
    assert {r["key"]: r["category"] for r in hierarchy.default_place(works, groups).collect()} == {"k0": "hebrew-bible", "k1": "apocrypha", "k2": "new-testament"}


def test_overlay(spark):
    a, b = (spark.createDataFrame(rows, "key string, v int") for rows in ([("x", 1)], [("x", 2), ("y", 3)]))
    assert sorted(map(tuple, catalog.first_of_overlays(spark, [a, b], "key").collect())) == [("x", 1), ("y", 3)]
