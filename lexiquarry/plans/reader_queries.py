"""Imports, personal items, links, contents and builds over the star schema, the event log and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import blocks, build, catalog, crossrefs, hierarchy, repair, search, state, study, validate
from ..sources import books
from .catalog_queries import _LOG, _MULTI, _WORKS, _groups, _list, _log, works
from .text_queries import documents, table

ASKED = ("", "restoration", "jewish", "apocrypha", "pseudepigrapha", "nowhere", "hebrew-bible", "sources")
ASKED_GROUPS = ("", "utah-lds", "other-rite", "torah", "biblical-apocrypha", "enochic", "christian-apocrypha")


def dense_index_nulls(spark, d):
    """Customers numbered by a nation that a third of them lacks."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation").filter("n_nationkey % 3 <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return catalog.dense_index(rows, ["n_name", "c_custkey"]).select("c_custkey", "n_name", F.col("work_index").cast("long").alias("work_index"))


def json_import(spark, d):
    """Conversations as imported books: turns as plain strings, objects with text and v, objects with value and label, and blank ones."""
    rows = table(spark, d, "conversations")
    k = F.col("turn") % 4
    turn = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), "text").alias("x")))).when(k == 1, F.to_json(F.struct(F.concat(F.lit("v"), "turn").alias("v"), F.concat(F.lit(" "), "text").alias("text")))).when(k == 2, F.to_json(F.struct("turn", F.lit("L").alias("label"), F.lit(7).alias("value")))).otherwise('{"text":" "}')
    item = F.when(k == 0, F.get_json_object(turn, "$.x")).otherwise(turn)
    item = F.when(k == 0, F.regexp_replace(F.to_json(F.array(item)), r"^\[|\]\z", "")).otherwise(item)
    files = rows.withColumn("item", item).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]), ",").alias("items"))
    # a book beside the chapters, titles and names at the top, a blank title, none at all, and chapters under a book
    heads = ('{"title":"Top","book":{"title":"Inner"},"chapterLabels":{"1":"One"},"chapters":{"1":[', '{"title":"","name":"Flat","chapters":{"1":[', '{"title":" \\t","chapters":{"1":[', '{"chapters":{"1":[', '{"title":"Top","book":{"name":"Named","chapterLabels":{"1":"Own"}},"chapters":{"1":[')
    files = files.select("conv_id", F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("conv_id") % 5 + 1).cast("int")), "items", F.lit("]}}")).alias("content"), F.concat(F.lit("File "), "conv_id", F.lit(".JSON")).alias("file"))
    return books.json_import(files, "conv_id", name="file").select("conv_id", "title", "chapter", "chapter_label", "label", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def import_keys(spark, d):
    """Keys of imports made of their content: some with an id of their own, some without a title, a source or both, some with blanks around the title."""
    k = F.col("conv_id") * 100 + F.col("turn")
    title = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, " ").when(k % 7 == 2, F.concat(F.lit("  Title "), k % 5, F.lit("\t"))).otherwise(F.concat(F.lit("Title "), k % 5))
    source = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise("a.json")
    chapters = F.create_map(F.lit("1"), F.array(F.struct(F.lit("1").alias("label"), F.concat(F.lit("x"), F.col("conv_id") % 10, F.lit(" "), F.md5("text")).alias("text"))))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(k % 3 == 0, F.concat(F.lit("own"), "conv_id")).alias("id"), source.alias("source"), title.alias("title"), chapters.alias("chapters"))
    return state.with_import_key(rows).select("conv_id", "turn", "key", "title", "source")


def _marks(spark, d):
    log = _log(spark, d).withColumn("chapter", (F.col("event_id") % 3).cast("string"))
    keys = ["user_id", "work", "chapter"]
    notes = state.notes(log.filter("kind = 'signup'"), keys).select(*keys, F.col("value").alias("text"))
    return notes, state.toggles(log.filter("kind = 'click'"), keys).select(*keys)


def personal_items(spark, d):
    """Notes and bookmarks of one chapter, with the titles of the works that are known."""
    notes, bookmarks = _marks(spark, d)
    titles = table(spark, d, "part").select(F.concat(F.lit("w"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("edition_title")).filter("key <> 'w5'")
    return state.with_work(state.personal_items(notes, bookmarks, chapter="1"), titles).select("user_id", "work", "chapter", "type", "text", "work_title", "work_edition")


def dashboard(spark, d):
    notes, bookmarks = _marks(spark, d)
    return state.dashboard({"notes": notes, "bookmarks": bookmarks, "imports": _log(spark, d).filter("kind = 'error'")}, ["user_id"])


def collection_saved(spark, d):
    """Collections saved again: creation times stay, a description that isn't given stays, the rest is new."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("user"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("created_at"))
    again = rows.filter("id % 3 = 0").withColumns({"title": F.lit("again"), "description": F.when(F.col("id") % 2 == 0, F.lit("said")), "created_at": F.lit(-1).cast("long")})
    fresh = again.filter("id % 9 = 0").withColumn("id", F.col("id") + 100_000_000)
    return state.saved(state.removed_row(rows, rows.filter("id % 7 = 0"), ["user", "id"]), again.unionByName(fresh))


def plan_defaults(spark, d):
    step = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("label")).alias("label"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("w"), "l_partkey")).alias("work"), F.lit(None).cast("string").alias("chapter"), F.when(F.col("l_returnflag") == "R", F.lit(True)).alias("complete"))
    plans = table(spark, d, "lineitem").withColumn("step", step).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "step"))).alias("s"))
    plans = plans.select("id", F.transform("s", lambda x: x["step"]).alias("steps")).withColumn("steps", state.plan_steps("steps"))
    rows = plans.select(F.col("id").alias("plan"), F.posexplode("steps").alias("k", "s"))
    return rows.select("plan", "k", "s.id", "s.label", "s.work", "s.chapter", "s.complete")


def parallels_by_alias(spark, d):
    """A verse of a book that has no references by its own name, found by the alias of another; and one that has some."""
    refs = table(spark, d, "lineitem").select(F.element_at(F.array(F.lit("Song of Songs"), F.lit("1 John"), F.lit("Orders")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("book"), (F.col("l_orderkey") % 20).cast("string").alias("chapter"), F.col("l_linenumber").cast("string").alias("verse"), F.lit("").alias("anchor"), F.concat(F.lit("see "), F.col("l_partkey") % 40).alias("reference"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    names = spark.createDataFrame([("Orders", 0), ("Song of Songs", 1), ("1 John", 2)], "name string, pos int")
    ask = lambda book, aliases: crossrefs.parallels_or_alias(refs, names, book, aliases, "7", "2").withColumn("asked", F.lit(book))
    return ask("Canticles", ["song"]).unionByName(ask("Orders", ["song"])).unionByName(ask("None", ["zzz"])).select("asked", "reference", "pos")


def route_context(spark, d):
    k = F.col("work_index")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    asked = works(spark, d).withColumns({"asked_category": pick(ASKED, F.floor(k / 2)), "asked_group": pick(ASKED_GROUPS, F.floor(k / 5)), "imported": k % 17 == 0})
    return hierarchy.route_context(asked, _groups(spark))


def home_counts(spark, d):
    segments = table(spark, d, "conversations").select(F.col("conv_id").alias("work_key"), (F.col("turn") % 3).alias("chapter"))
    return hierarchy.home_counts(works(spark, d), segments, table(spark, d, "labels").select(F.col("doc_id").alias("work_key")))


def linked_sources(spark, d):
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit(0).alias("producer"), F.col("item_id").alias("pos"), F.substring("text", 1, 10).alias("title"))
    return search.linked(rows, ["producer", "pos"]).select("id", "label")


def model_names(spark, d):
    """Names of what each user's events could be answered by: trimmed, distinct, in the order of the list."""
    one = lambda n: F.struct(F.concat(F.lit(" m"), F.col("user_id") % n).alias("name"), F.concat(F.lit("x"), F.col("user_id") % 2).alias("model"))
    rows = table(spark, d, "events").select("user_id").distinct().select("user_id", F.array(one(3), one(2), F.struct(F.lit(" ").alias("name"), F.when(F.col("user_id") % 5 == 0, "Llama3.2:3B").alias("model")), one(3)).alias("models"))
    return search.model_names(rows, ["user_id"]).select("user_id", F.array_join("names", ",").alias("names"), "preferred")


def chosen_editions(spark, d):
    return catalog.chosen_editions(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("id")), "Brand#1", ("Brand#20",))


def content_validation(spark, d):
    """Payloads that are broken by rule: not JSON, without sections, a section that isn't a list, blank texts, no payload at all."""
    k = F.col("c_custkey")
    content = F.when(k % 11 == 0, "{broken").when(k % 11 == 1, '{"chapters":{}}').when(k % 11 == 2, '{"chapters":{"1":"text"}}').when(k % 11 == 3, '{"chapters":{"1":[{"text":"a"},{"text":" "},{"text":5},{}]}}').otherwise('{"chapters":{"1":[{"text":"a"}],"2":[]}}')
    files = validate.dealt(table(spark, d, "customer").select(F.concat(F.lit("c/"), k).alias("key"), content.alias("content"), k), "key")
    return validate.report(validate.content_rules(files.filter("c_custkey % 11 <> 4").drop("c_custkey"), files.select("key")))


def shown_violations(spark, d):
    return validate.shown(content_validation(spark, d))


def manifest_counts(spark, d):
    actual = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    said = actual.withColumn("n", F.when(F.col("name") == "F", F.col("n") + 1).otherwise(F.col("n"))).filter("name <> 'O'").unionByName(spark.createDataFrame([("gone", 3)], "name string, n long"))
    return validate.report(validate.manifest_rules(said, actual))


def digest_mismatch(spark, d):
    files = documents(spark, d).select(F.col("doc_id").cast("string").alias("key"), hashing.sha256(F.col("text")).alias("sha256"))
    said = files.withColumn("sha256", F.when(F.col("key").endswith("7"), F.lit("0")).otherwise(F.col("sha256")))
    return validate.wrong_digests(files.filter("key NOT LIKE '%3'"), said)


def bracketed_lines(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("["), x["turn"] % 3, F.lit(":"), x["turn"], F.lit("]  "), x["role"])), "\n\n").alias("text"))
    segments, totals = build.transcription(blocks.lines_of(rows, "conv_id"), "conv_id")
    return segments.join(totals, "conv_id").select("conv_id", "chapter", "verse", "text", "chapters", "segments")


def merged_headings(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("number"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("l_partkey").cast("string"), F.lit("x"))).alias("segments"))
    return blocks.merged_headings(rows, "l_orderkey", "number", "pos")


def contained_nodes(spark, d):
    """Customers as nodes below nations, those of some nations."""
    up = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("scroll").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"))
    down = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.lit("line").alias("kind"), F.col("c_nationkey").cast("long").alias("parent_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    return blocks.contained(up.unionByName(down), up.filter("id % 4 = 0").select("name"), "scroll", "line")


def lexicon_rows(spark, d):
    rows = table(spark, d, "part").select(F.element_at(F.array(F.lit("strongsGreek"), F.lit("stepGreek"), F.lit("strongsHebrew")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("source"), F.concat(F.lit("G"), F.when(F.col("p_partkey") % 2 == 0, F.lpad((F.col("p_partkey") % 50).cast("string"), 4, "0")).otherwise(F.col("p_partkey") % 50)).alias("key"), F.when(F.col("p_partkey") % 7 != 0, F.concat("p_name", F.lit("/"), "p_partkey")).alias("record"))
    return study.lexicon_rows(rows, " g 025 ").unionByName(study.lexicon_rows(rows, "love"))


def unresolved_mapping(spark, d):
    mapping = table(spark, d, "customer").select(F.col("c_custkey").alias("work_key"), F.when(F.col("c_custkey") % 2 == 0, "bible").otherwise("other").alias("kind"), F.col("c_nationkey").alias("study_id"))
    resources = table(spark, d, "nation").filter("n_nationkey < 15").select(F.lit("bible").alias("kind"), F.col("n_nationkey").alias("study_id"))
    return study.unresolved(mapping, resources)


def overlay_rows(spark, d):
    a = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.lit("new").alias("v"))
    return catalog.first_of_overlays(spark, [a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("old").alias("v"))], "key")


def chapter_map(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") % 2).alias("chapter"), "role")
    return build.chapter_map(rows, "conv_id", "chapter", "role")


def replaced_repairs(spark, d):
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), "p_partkey").alias("id"), F.lit("old").alias("note"))
    return repair.replaced_repairs(rows, rows.limit(0).unionByName(spark.createDataFrame([("Brand#1x", "new")], "id string, note string")), "Brand#1")


def index_build(spark, d):
    """Works, passages and bytes of the index of searchable works, with the tokens of each shard."""
    works_ = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("work_index"), (F.col("p_partkey") % 3 != 0).alias("searchable"))
    stats, tokens, _ = build.index_build(documents(spark, d).select((F.floor(F.col("doc_id") / 4)).alias("work_key"), "text"), works_)
    return stats.join(tokens.groupBy("shard").agg(F.count(F.lit(1)).alias("tokens")), "shard", "left")


NAMES = ("dense_index_nulls", "json_import", "import_keys", "personal_items", "dashboard", "collection_saved", "plan_defaults", "parallels_by_alias", "route_context", "home_counts", "linked_sources", "model_names", "chosen_editions", "content_validation", "shown_violations", "manifest_counts", "digest_mismatch", "bracketed_lines", "merged_headings", "contained_nodes", "lexicon_rows", "unresolved_mapping", "overlay_rows", "chapter_map", "replaced_repairs", "index_build")
QUERIES = {n: globals()[n] for n in NAMES}

_MARKS = f"{_LOG}, h AS (SELECT *, CAST(event_id % 3 AS VARCHAR) AS chapter FROM g), notes AS (SELECT user_id, work, chapter, arg_max(value, (ts, event_id)) AS text FROM h WHERE kind = 'signup' GROUP BY ALL HAVING trim(arg_max(value, (ts, event_id))) <> ''), marks AS (SELECT user_id, work, chapter FROM h WHERE kind = 'click' GROUP BY ALL HAVING count(*) % 2 = 1)"
_BRIDGE = "br AS (SELECT * FROM (VALUES ('restoration', 'utah-lds', 0, 'bom1830'), ('restoration', 'utah-lds', 0, 'kjv'), ('restoration', 'utah-lds', 0, 'pgp1851'), ('restoration', 'other-rite', 1, 'bom1830'), ('jewish', 'torah', 2, 'jewish-scripture-torah'), ('jewish', 'torah', 2, 'torah-jps1917'), ('jewish', 'prophets', 3, 'jps1917')) AS v(c, g, o, e))"
_PLACE = """CASE WHEN rg IS NOT NULL AND NOT bible THEN ['restoration', rg] WHEN jg IS NOT NULL AND NOT bible THEN ['jewish', jg] WHEN apo THEN ['apocrypha', 'christian-apocrypha'] WHEN pse THEN ['pseudepigrapha', CASE WHEN eno THEN 'enochic' ELSE 'other-pseudepigrapha' END] WHEN gno THEN ['gnostic', ''] WHEN section = 'Hymns & Songs' THEN ['hymns', ''] WHEN early THEN ['early-christian', ''] WHEN eth THEN ['ethiopian', ''] WHEN bible AND part = 'nt' THEN ['new-testament', ''] WHEN bible AND part = 'other' THEN ['apocrypha', 'biblical-apocrypha'] WHEN bible THEN ['hebrew-bible', ''] WHEN content_state <> 'local-readable' THEN ['sources', ''] ELSE ['hebrew-bible', ''] END"""
_HOLDS = "coalesce(CASE category WHEN 'apocrypha' THEN ({0} = 'biblical-apocrypha' AND bible AND part = 'other') OR ({0} = 'christian-apocrypha' AND apo) WHEN 'pseudepigrapha' THEN ({0} = 'enochic' AND eno) OR ({0} = 'other-pseudepigrapha' AND NOT eno) ELSE EXISTS (SELECT 1 FROM br WHERE br.c = category AND br.g = {0} AND br.e = edition_id) AND NOT (category = 'restoration' AND edition_id = 'kjv' AND part = 'other') END, false)"
_CONTENT = "p AS (SELECT 'c/' || CAST(c_custkey AS VARCHAR) AS key, c_custkey % 11 AS k FROM customer), v AS (SELECT 'work-has-payload' AS rule, key AS subject, '' AS detail FROM p WHERE k = 4 UNION ALL SELECT 'payload-is-json', key, '' FROM p WHERE k = 0 UNION ALL SELECT 'payload-has-sections', key, '' FROM p WHERE k = 1 UNION ALL SELECT 'section-is-array', key || '|1', '' FROM p WHERE k = 2 UNION ALL SELECT 'segment-has-text', key || '|1|' || CAST(unnest([2, 3, 4]) AS VARCHAR), '' FROM p WHERE k = 3)"

ORACLES = {
    "dense_index_nulls": "SELECT c_custkey, n_name, row_number() OVER (ORDER BY n_name NULLS FIRST, c_custkey) - 1 AS work_index FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0",
    "json_import": r"""WITH s AS (SELECT conv_id, turn % 4 AS k, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, CASE turn % 4 WHEN 0 THEN ' ' || text WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 2 THEN '7' END AS t FROM conversations)
      SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'Inner' WHEN 1 THEN 'Flat' WHEN 2 THEN 'Imported book' WHEN 3 THEN 'File ' || CAST(conv_id AS VARCHAR) ELSE 'Named' END AS title, '1' AS chapter,
        CASE conv_id % 5 WHEN 0 THEN 'One' WHEN 4 THEN 'Own' END AS chapter_label, CASE k WHEN 0 THEN CAST(place AS VARCHAR) WHEN 1 THEN 'v' || CAST(turn AS VARCHAR) ELSE 'L' END AS label, md5(t) AS digest FROM s WHERE t IS NOT NULL AND (k = 0 OR t <> '')""",
    "import_keys": """WITH k AS (SELECT *, conv_id * 100 + turn AS k FROM conversations),
      t AS (SELECT *, CASE WHEN k % 7 < 2 THEN 'Imported book' ELSE 'Title ' || CAST(k % 5 AS VARCHAR) END AS title, CASE WHEN k % 4 < 2 THEN 'local import' ELSE 'a.json' END AS source FROM k),
      r AS (SELECT *, source || chr(10) || title || chr(10) || '{"1":[{"label":"1","text":"x' || CAST(conv_id % 10 AS VARCHAR) || ' ' || md5(text) || '"}]}' AS s FROM t)
      SELECT conv_id, turn, title, source, 'import/' || CASE WHEN k % 3 = 0 THEN 'own' || CAST(conv_id AS VARCHAR) ELSE 'u-' || lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ord(substr(s, i, 1)) AS BIGINT) FOR i IN range(1, length(s) + 1)]), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)) END AS key FROM r""",
    "personal_items": f"WITH {_MARKS}, a AS (SELECT user_id, work, chapter, 'note' AS type, text FROM notes UNION ALL SELECT user_id, work, chapter, 'bookmark', NULL FROM marks) SELECT user_id, work, chapter, type, text, p_name AS work_title, p_brand AS work_edition FROM a JOIN part ON work = 'w' || CAST(p_partkey AS VARCHAR) WHERE chapter = '1' AND work <> 'w5'",
    "dashboard": f"WITH {_MARKS}, a AS (SELECT user_id, 'notes' AS kind FROM notes UNION ALL SELECT user_id, 'bookmarks' FROM marks UNION ALL SELECT user_id, 'imports' FROM g WHERE kind = 'error'), u AS (SELECT DISTINCT user_id FROM a) SELECT u.user_id, k.kind, count(a.user_id) AS n FROM u CROSS JOIN (SELECT unnest(['notes', 'bookmarks', 'imports']) AS kind) k LEFT JOIN a ON a.user_id = u.user_id AND a.kind = k.kind GROUP BY ALL",
    "collection_saved": 'WITH r AS (SELECT o_custkey % 50 AS "user", o_orderkey AS id, o_orderstatus AS title, o_orderpriority AS description, o_orderkey AS created_at FROM orders), c AS (SELECT * FROM r WHERE id % 7 <> 0), n AS (SELECT "user", id, CASE WHEN id % 2 = 0 THEN \'said\' END AS description FROM r WHERE id % 3 = 0) SELECT * FROM c WHERE id % 3 <> 0 UNION ALL SELECT n."user", n.id, \'again\', coalesce(n.description, c.description), coalesce(c.created_at, -1) FROM n LEFT JOIN c ON c."user" = n."user" AND c.id = n.id UNION ALL SELECT "user", id + 100000000, \'again\', description, -1 FROM n WHERE id % 9 = 0',
    "plan_defaults": "WITH s AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag = 'R') AS n, * FROM lineitem) SELECT plan, CAST(n - 1 AS INTEGER) AS k, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS id, CASE WHEN l_partkey % 3 <> 0 THEN 'label' WHEN l_partkey % 2 = 0 THEN 'w' || CAST(l_partkey AS VARCHAR) ELSE 'Step ' || CAST(n AS VARCHAR) END AS label, CASE WHEN l_partkey % 2 = 0 THEN 'w' || CAST(l_partkey AS VARCHAR) ELSE '' END AS work, '1' AS chapter, l_returnflag = 'R' AS complete FROM s",
    "parallels_by_alias": "WITH q AS (SELECT l_orderkey % 3 AS b, 'see ' || CAST(l_partkey % 40 AS VARCHAR) AS reference, l_orderkey * 10 + l_linenumber AS pos FROM lineitem WHERE l_orderkey % 20 = 7 AND l_linenumber = 2) SELECT CASE WHEN b = 0 THEN 'Canticles' ELSE 'Orders' END AS asked, reference, min(pos) AS pos FROM q WHERE b IN (0, 2) GROUP BY b, reference",
    "route_context": f"""WITH {_WORKS}, {_BRIDGE}, mm AS ({_MULTI}), a AS (SELECT *, {_list(ASKED)}[(work_index // 2) % {len(ASKED)} + 1] AS ac, {_list(ASKED_GROUPS)}[(work_index // 5) % {len(ASKED_GROUPS)} + 1] AS ag, {_PLACE} AS pl FROM y),
      k AS (SELECT *, EXISTS (SELECT 1 FROM mm WHERE mm.key = a.key AND mm.category_id = ac) AS known FROM a), c AS (SELECT *, CASE WHEN known THEN ac ELSE pl[1] END AS category, CASE WHEN known THEN ag ELSE pl[2] END AS wanted FROM k),
      i AS (SELECT *, (SELECT arg_min(g, o) FROM br WHERE br.c = category AND br.e = edition_id) AS inferred FROM c)
      SELECT key, CASE WHEN work_index % 17 = 0 THEN '' ELSE category END AS category, CASE WHEN work_index % 17 = 0 THEN '' WHEN wanted <> '' AND (NOT known OR {_HOLDS.format('wanted')}) THEN wanted WHEN inferred IS NOT NULL AND {_HOLDS.format('inferred')} THEN inferred ELSE '' END AS "group" FROM i""",
    "home_counts": f"WITH {_WORKS} SELECT (SELECT count(*) FROM w WHERE content_state = 'local-readable') AS readable, (SELECT count(*) FROM w) AS records, (SELECT count(DISTINCT (conv_id, turn % 3)) FROM conversations) AS sections, (SELECT count(DISTINCT doc_id) FROM labels) AS mappings",
    "linked_sources": "SELECT 'b' || CAST(item_id AS VARCHAR) AS id, '[b' || CAST(item_id AS VARCHAR) || '] ' || left(text, 10) AS label FROM benchmark ORDER BY item_id LIMIT 14",
    "model_names": "WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, 'm' || CAST(user_id % 3 AS VARCHAR) AS a, 'm' || CAST(user_id % 2 AS VARCHAR) AS b, user_id % 5 = 0 AS l FROM u) SELECT user_id, a || CASE WHEN a = b THEN '' ELSE ',' || b END || CASE WHEN l THEN ',Llama3.2:3B' ELSE '' END AS names, CASE WHEN l THEN 'Llama3.2:3B' ELSE a END AS preferred FROM n",
    "chosen_editions": "SELECT p_partkey, p_brand AS id FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#20'",
    "content_validation": f"WITH {_CONTENT} SELECT * FROM v",
    "shown_violations": f"WITH {_CONTENT} SELECT * FROM v ORDER BY rule, subject, detail LIMIT 100",
    "manifest_counts": "WITH a AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1) SELECT 'manifest-count' AS rule, name AS subject, CASE WHEN name = 'F' THEN 'said ' || CAST(n + 1 AS VARCHAR) ELSE 'said missing' END || ', found ' || CAST(n AS VARCHAR) AS detail FROM a WHERE name IN ('F', 'O') UNION ALL SELECT 'manifest-count', 'gone', 'said 3, found missing'",
    "digest_mismatch": "SELECT 'digest' AS rule, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 10 = 3 THEN 'missing' ELSE sha256(text) END AS detail FROM documents WHERE doc_id % 10 IN (3, 7)",
    "bracketed_lines": "SELECT conv_id, CAST(turn % 3 AS VARCHAR) AS chapter, CAST(turn AS VARCHAR) AS verse, role AS text, c.chapters, c.segments FROM conversations JOIN (SELECT conv_id, count(DISTINCT turn % 3) AS chapters, count(*) AS segments FROM conversations GROUP BY 1) c USING (conv_id)",
    "merged_headings": "WITH s AS (SELECT l_orderkey, l_returnflag AS number, l_linenumber * 1000000 + l_partkey AS pos, unnest([0, 1]) AS i, unnest([CAST(l_partkey AS VARCHAR), 'x']) AS segment FROM lineitem WHERE l_partkey % 4 <> 0) SELECT l_orderkey, number, CAST(row_number() OVER (PARTITION BY l_orderkey, number ORDER BY pos, i) AS INTEGER) AS label, segment FROM s",
    "contained_nodes": "SELECT n_name AS parent_name, c_custkey + 1000 AS id, c_name AS name, c_custkey AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 = 0",
    "lexicon_rows": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'strongsGreek' ELSE 'stepGreek' END AS source, 'G' || CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey % 50 AS VARCHAR), 4, '0') ELSE CAST(p_partkey % 50 AS VARCHAR) END AS key, p_name || '/' || CAST(p_partkey AS VARCHAR) AS record FROM part WHERE p_partkey % 50 = 25 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0",
    "unresolved_mapping": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'bible' ELSE 'other' END AS kind, c_nationkey AS study_id, c_custkey AS work_key FROM customer WHERE c_custkey % 2 <> 0 OR c_nationkey >= 15",
    "overlay_rows": "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM supplier",
    "chapter_map": "SELECT conv_id, turn % 2 AS chapter, role, count(*) AS segments FROM conversations GROUP BY ALL",
    "replaced_repairs": "SELECT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS id, 'old' AS note FROM part WHERE NOT starts_with(p_brand, 'Brand#1') UNION ALL SELECT 'Brand#1x', 'new'",
    "index_build": r"WITH s AS (SELECT p_partkey % 64 AS shard, p_partkey, text FROM documents JOIN part ON p_partkey = doc_id // 4 WHERE p_partkey % 3 <> 0), k AS (SELECT shard, count(DISTINCT t) AS tokens FROM (SELECT shard, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']{2,}')) AS t FROM s) GROUP BY 1) SELECT CAST(shard AS INTEGER) AS shard, count(DISTINCT p_partkey) AS works, count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, any_value(tokens) AS tokens FROM s LEFT JOIN k USING (shard) GROUP BY shard",
}
