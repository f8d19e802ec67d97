"""Catalogue, hierarchy, cross references, validation and user state over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, catalog, crossrefs, hierarchy, state, study, validate
from .text_queries import table

EVENT_KINDS = ("click", "error", "purchase", "signup", "view", "refund")
# Editions, names and sections that the classification queries deal out over parts, by key.
EDITIONS = ("kjv", "web", "torah-jps1917", "enoch-charles", "pseudepigrapha-open-ii", "early-christian-sacred-i", "gnostic-nag-i", "christian-apocrypha-open-i", "research-open", "pgp1851", "hymnal-i", "jps1917", "bom1830", "plain-edition")
NAMES = ("Genesis", "1 John", "Tobit", "Book of Giants", "Pistis Sophia", "Gospel of Thomas", "Tewahedo Order", "Song of Songs", "Enoch", "Psalms")
SECTIONS = ("", "Hymns & Songs", "Pseudepigrapha", "Christian Apocrypha")
TAXONOMY = [("restoration", "utah-lds", ["bom1830", "kjv"]), ("restoration", "other-rite", ["bom1830"]), ("jewish", "torah", ["jewish-scripture-torah"]), ("jewish", "prophets", ["jps1917"])]


def _dealt(values: tuple[str, ...], by) -> "F.Column":
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def works(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("w/"), k).alias("key"), k.alias("work_index"), _dealt(EDITIONS, k % len(EDITIONS)).alias("edition_id"), F.concat(F.lit("Source Pack "), (k % 5).cast("string")).alias("edition_title"),
        F.lit(None).cast("string").alias("collection_label"), F.col("p_type").alias("title"), _dealt(NAMES, F.floor(k / 3) % len(NAMES)).alias("name"), _dealt(SECTIONS, F.floor(k / 7) % len(SECTIONS)).alias("section"),
        _dealt(catalog.STATES, F.floor(k / 11) % 4).alias("content_state"))


def _groups(spark):
    return hierarchy.group_table(spark, TAXONOMY)


def classify_default(spark, d):
    return hierarchy.default_place(works(spark, d), _groups(spark)).select("key", "category", "group")


def classify_multilabel(spark, d):
    return hierarchy.categories_of(works(spark, d), _groups(spark)).select("key", "part", "category_id")


def category_summary(spark, d):
    return hierarchy.summary(hierarchy.categories_of(works(spark, d), _groups(spark)), ["category_id"])


def group_records(spark, d):
    rows, groups = works(spark, d), _groups(spark)
    one = lambda c, g: hierarchy.records(rows, groups, c, g).select(F.lit(c).alias("category"), F.lit(g).alias("group"), "key")
    return one("restoration", "utah-lds").unionByName(one("pseudepigrapha", "enochic")).unionByName(one("apocrypha", "biblical-apocrypha"))


def acquisition_works(spark, d):
    return hierarchy.shelves(works(spark, d))[1].select("key", "edition_id")


def distinct_first_seen(spark, d):
    return hierarchy.first_seen(table(spark, d, "documents"), "lang", "doc_id")


def shelf_summary(spark, d):
    good = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return hierarchy.summary(good.withColumn("content_state", F.when(F.col("quality") == 1, hierarchy.READABLE).otherwise("bibliographic")), ["source"])


def state_histogram_zero_filled(spark, d):
    return catalog.histogram(table(spark, d, "events"), "event_type", EVENT_KINDS)


def dense_index(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.dense_index(rows, ["n_name", "c_custkey"]).select("c_custkey", "n_name", F.col("work_index").cast("long").alias("work_index"))


def edition_rollup(spark, d):
    books = table(spark, d, "part").select(F.col("p_brand").alias("edition_id"), F.col("p_size").alias("chapters"), (F.col("p_partkey") % 10).alias("verses"))
    return catalog.edition_rollup(books)


def upsert_works(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("has").alias("url"))
    current, new = rows.filter("s_suppkey % 3 <> 0"), rows.select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), F.lit("given").alias("url"))
    return catalog.upsert(current, new, ["s_suppkey"], ("url",))


def mapping_coverage(spark, d):
    return catalog.coverage(table(spark, d, "labels").select(F.col("doc_id").alias("work_key")), table(spark, d, "documents").select(F.col("doc_id").alias("work_key")))


def mapping_kinds(spark, d):
    return table(spark, d, "labels").groupBy(F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def works_with_editions(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation").filter("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("n_name", F.lit("Unknown edition")).alias("edition"))


def _references(spark, d):
    ref = F.concat(F.lit("Order "), "l_orderkey", F.lit(":"), "l_linenumber", F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("-"), F.col("l_linenumber") + 3)).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit(","), F.col("l_linenumber") + 2)).when(F.col("l_partkey") % 4 == 2, "0").otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ref.alias("reference"))


def backlinks_prefix(spark, d):
    targets = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.concat(F.lit("order "), "o_orderkey", F.lit(":1")).alias("target"))
    return crossrefs.backlinks(_references(spark, d), targets).select("l_orderkey", "l_linenumber", "reference", "target")


def xref_invert(spark, d):
    out = crossrefs.invert(_references(spark, d), "l_partkey", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])
    return out.select("l_partkey", F.size("sources").alias("n"), F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["l_orderkey"].cast("string"), s["l_linenumber"].cast("string"))), " ").alias("sources"))


def _crossrefs(spark, d):
    return _references(spark, d).select(F.lit("Orders").alias("book"), (F.col("l_orderkey") % 50).cast("string").alias("chapter"), (F.col("l_linenumber") % 3).cast("string").alias("verse"), F.concat(F.lit("part "), "l_partkey").alias("anchor"), F.concat(F.lit("see "), F.col("l_partkey") % 40).alias("reference"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def parallel_passages(spark, d):
    return crossrefs.parallels(_crossrefs(spark, d), "Orders", "7", "2")


def references_by_verse(spark, d):
    return crossrefs.by_verse(_crossrefs(spark, d)).select("chapter", "verse", "first_pos", F.size("refs").alias("n"))


def orphan_anti(spark, d):
    rows = table(spark, d, "lineitem")
    return validate.orphans(rows.withColumn("o", F.col("l_orderkey")), table(spark, d, "orders").filter("o_orderkey % 11 <> 0"), "o", "o_orderkey", "line-has-order").groupBy("rule", "subject").agg(F.count(F.lit(1)).alias("n"))


def fk_violations(spark, d):
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("key")), table(spark, d, "labels").select(F.col("doc_id").alias("work_key"))
    n = validate.parts(docs, "key")
    return validate.report(validate.mapping_rules(validate.dealt(labels, "work_key", n), validate.dealt(docs, "key", n)))


def duplicate_keys(spark, d):
    return validate.duplicates(table(spark, d, "events"), ["user_id", "event_type"], "unique-event")


def work_validation(spark, d):
    rows = validate.dealt(works(spark, d).select("key", "content_state", F.when(F.col("work_index") % 13 != 0, F.col("key")).alias("reader_path"), F.when(F.col("work_index") % 5 == 0, "ftp://x").otherwise("https://x").alias("source_url")), "key")
    local = rows.filter("content_state = 'local-readable' OR key LIKE '%7'").select("key")
    return validate.report(validate.work_rules(rows, local))


def validation_verdict(spark, d):
    return validate.verdict(work_validation(spark, d))


def _log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 23).alias("work"), F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.col("props")).alias("value"))


def last_position(spark, d):
    return state.last_by(_log(spark, d).filter("kind = 'view'"), ["user_id", "work"]).select("user_id", "work", "value")


def bookmark_toggle(spark, d):
    return state.toggles(_log(spark, d).filter("kind = 'click'"), ["user_id", "work"])


def highlight_toggle(spark, d):
    rows = _log(spark, d).filter("kind = 'purchase'").withColumn("value", F.when(F.col("event_id") % 2 == 0, "").otherwise("blue"))
    return state.toggles(rows, ["user_id", "work"], "value")


def note_last_write(spark, d):
    return state.notes(_log(spark, d).filter("kind = 'signup'"), ["user_id", "work"]).select("user_id", "work", "value")


def history_dedup_cap(spark, d):
    return state.history(_log(spark, d), ["user_id"], ["work", "kind"]).select("user_id", "work", "kind", "ts", "place")


def import_cascade_delete(spark, d):
    log = _log(spark, d)
    imports = log.withColumn("kind", F.when(F.col("kind") == "error", "remove-import").when(F.col("kind") == "signup", "import").otherwise(F.col("kind")))
    events = state.since_removal(log, state.removals(imports, ["user_id"]), ["user_id"])
    return state.toggles(events.filter("kind = 'click'"), ["user_id", "work"])


def import_then_reimport(spark, d):
    """The visits that are left: a removal takes those before it along, an import after it doesn't bring them back."""
    log = _log(spark, d)
    imports = log.withColumn("kind", F.when(F.col("kind") == "error", "remove-import").when(F.col("kind") == "signup", "import").otherwise(F.col("kind")))
    events = state.since_removal(log, state.removals(imports, ["user_id"]), ["user_id"])
    return state.history(events.filter("kind = 'view'"), ["user_id"], ["work"]).select("user_id", "work", "ts", "place")


def plan_progress(spark, d):
    plans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("complete")))).alias("steps"))
    return state.progress(state.with_step(plans, 1, 0, True))


def collection_replace(spark, d):
    items = table(spark, d, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.lit("old").alias("note"))
    new = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("new").alias("note"))
    return state.replaced(items, new, ["l_orderkey", "l_linenumber"])


def annotated_chapter(spark, d):
    segments = table(spark, d, "events").select("user_id", F.concat(F.lit("w"), F.col("event_id") % 23).alias("work")).distinct()
    log = _log(spark, d)
    marks, notes = state.toggles(log.filter("kind = 'click'"), ["user_id", "work"]), state.notes(log.filter("kind = 'signup'"), ["user_id", "work"])
    colours = state.toggles(log.filter("kind = 'purchase'"), ["user_id", "work"], "value")
    return state.annotated(segments, marks, colours, notes, ["user_id", "work"])


def sources_listing(spark, d):
    return works(spark, d).filter("content_state <> 'local-readable'").orderBy("work_index").limit(250).select("key", "content_state")


def titles_in_order(spark, d):
    return hierarchy.by_title(table(spark, d, "part").select(F.col("p_name").alias("title")).distinct())


def study_context(spark, d):
    """Orders as study records: commentary by line, references by part, the first twelve of each chapter."""
    line = table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).cast("string").alias("study_id"), (F.col("l_orderkey") % 3).cast("string").alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_returnflag", "l_partkey", "l_linenumber")
    notes = study.commentary_rows(line.filter("l_linenumber = 1").select("study_id", "chapter", "pos", F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("verses"), F.when(F.col("l_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" part "), "l_partkey")).alias("text")))
    refs = study.reference_rows(line.filter("l_linenumber > 4").select("study_id", "chapter", "pos", F.col("l_returnflag").alias("verse"), F.lit("").alias("anchor"), F.array(F.col("l_partkey").cast("string"), F.lit("x")).alias("references")))
    return study.context(notes.unionByName(refs)).select("study_id", "chapter", "id", "passage", "text", "place")


def study_profiles(spark, d):
    rows = table(spark, d, "part").select(F.lit("reference").alias("kind"), F.col("p_partkey").cast("string").alias("study_id"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("sourceUrl"), F.lit("u"), F.lit("size"), F.when(F.col("p_size") > 25, "").otherwise(F.col("p_size").cast("string"))).alias("fields"))
    return study.context(study.profile_rows(rows)).select("study_id", "id", "passage", "text")


def study_mapping(spark, d):
    """Customers as works, nations as resources of two kinds, one of which some mappings miss."""
    mapping = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("work_key"), F.when(F.col("c_custkey") % 2 == 0, "bible").otherwise("reference").alias("kind"), F.col("c_nationkey").alias("study_id"))
    nation = table(spark, d, "nation")
    resources = nation.select(F.lit("bible").alias("kind"), F.col("n_nationkey").alias("study_id"), F.col("n_name").alias("title")).unionByName(nation.filter("n_nationkey < 15").select(F.lit("reference").alias("kind"), F.col("n_nationkey").alias("study_id"), F.lower("n_name").alias("title")))
    works_ = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return study.resolved(works_, mapping, resources).select("key", "kind", "title")


def work_extraction(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("edition_ord"), F.col("p_partkey").alias("book_ord"), F.concat_ws("/", F.regexp_replace("p_brand", "#", "-"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_partkey") % 3 == 0, "bibliographic").when(F.col("p_partkey") % 3 == 1, "source-readable").alias("availability"), F.lit("").alias("url1"), F.when(F.col("p_partkey") % 2 == 0, "http://a").alias("url2"), F.lit(None).cast("string").alias("url3"), F.lit("http://z").alias("url4"))
    return build.extracted(rows, rows.filter("book_ord % 7 = 0").select("key")).select("key", "content_state", "source_url", "reader_path", F.col("work_index").cast("long").alias("work_index"))


def work_integration(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("edition_ord"), F.col("s_suppkey").alias("book_ord"), F.col("s_name").alias("key"))
    base = catalog.dense_index(rows.filter("book_ord % 2 = 0"), ["edition_ord", "book_ord", "key"])
    return build.integrated(base, rows).select("key", F.col("work_index").cast("long").alias("work_index"))


def acquisition_report(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", F.lit(0).alias("chapter_ord"), F.col("turn").alias("seg_idx"), "text")
    return build.report(rows, "conv_id", "role")


def companion_records(spark, d):
    rows = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("c"), "l_orderkey").alias("id"), F.concat(F.lit("w/"), F.col("l_partkey") % 50).alias("primary_work"), F.concat(F.lit("w/"), F.col("l_suppkey") + 5).alias("companion_work"))
    titles = table(spark, d, "part").select(F.concat(F.lit("w/"), "p_partkey").alias("key"), F.col("p_name").alias("title")).filter("key <> 'w/7'")
    return crossrefs.companions(rows, titles, "w/10").select("id", "companion_work", "companion_title")


QUERY_NAMES = ("study_context", "study_profiles", "study_mapping", "work_extraction", "work_integration", "acquisition_report", "companion_records", "classify_default", "classify_multilabel", "category_summary", "group_records", "acquisition_works", "distinct_first_seen", "shelf_summary", "state_histogram_zero_filled", "dense_index", "edition_rollup", "upsert_works", "mapping_coverage", "mapping_kinds", "works_with_editions", "backlinks_prefix", "xref_invert", "parallel_passages", "references_by_verse", "orphan_anti", "fk_violations", "duplicate_keys", "work_validation", "validation_verdict", "last_position", "bookmark_toggle", "highlight_toggle", "note_last_write", "history_dedup_cap", "import_cascade_delete", "import_then_reimport", "plan_progress", "collection_replace", "annotated_chapter", "sources_listing", "titles_in_order")
QUERIES = {n: globals()[n] for n in QUERY_NAMES}

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_in = lambda column, values: f"coalesce({column} IN ({_list(values)[1:-1]}), false)"
_WORKS = f"""w AS (SELECT 'w/' || CAST(p_partkey AS VARCHAR) AS key, p_partkey AS work_index, {_list(EDITIONS)}[p_partkey % {len(EDITIONS)} + 1] AS edition_id,
  'Source Pack ' || CAST(p_partkey % 5 AS VARCHAR) AS edition_title, p_type AS title, {_list(NAMES)}[(p_partkey // 3) % {len(NAMES)} + 1] AS name,
  {_list(SECTIONS)}[(p_partkey // 7) % {len(SECTIONS)} + 1] AS section, {_list(catalog.STATES)}[(p_partkey // 11) % 4 + 1] AS content_state FROM part),
x AS (SELECT *, lower(edition_id || ' ' || edition_title || '  ' || title || ' ' || name) AS words,
  CASE WHEN {_in('lower(name)', hierarchy.OT_NAMES)} THEN 'ot' WHEN {_in('lower(name)', hierarchy.NT_NAMES)} THEN 'nt' ELSE 'other' END AS part,
  CASE WHEN edition_id IN ('bom1830', 'kjv', 'pgp1851') THEN 'utah-lds' END AS rg, CASE WHEN edition_id IN ('jewish-scripture-torah', 'torah-jps1917') THEN 'torah' WHEN edition_id = 'jps1917' THEN 'prophets' END AS jg FROM w),
y AS (SELECT *, {_in('edition_id', hierarchy.BIBLE_EDITIONS)} AS bible, section = 'Christian Apocrypha' OR starts_with(edition_id, 'christian-apocrypha-') AS apo,
  section = 'Pseudepigrapha' OR starts_with(edition_id, 'pseudepigrapha-') OR {_in('edition_id', hierarchy.ENOCHIC_EDITIONS + hierarchy.PSEUDEPIGRAPHA_EDITIONS)} AS pse,
  starts_with(edition_id, 'early-christian-') AS early, starts_with(edition_id, 'gnostic-') OR (edition_id = 'early-christian-sacred-i' AND contains(words, 'pistis sophia'))
  OR (edition_id = 'christian-apocrypha-open-i' AND regexp_matches(words, '{hierarchy.GNOSTIC_WORDS}')) AS gno, regexp_matches(words, 'tewahedo|ethiop') AS eth,
  {_in('edition_id', hierarchy.ENOCHIC_EDITIONS)} OR regexp_matches(words, '\\benoch\\b|book of giants') AS eno FROM x)"""
_FLAGS = ("(bible OR edition_id IN ('jewish-scripture-torah', 'torah-jps1917')) AND part = 'ot'", "bible AND part = 'nt'", "(bible AND part = 'other') OR apo", "pse", "early", "gno", "section = 'Hymns & Songs' OR regexp_matches(words, 'hymn|song|sacred poetry')", "eth", "rg IS NOT NULL", "jg IS NOT NULL", "content_state <> 'local-readable' OR starts_with(edition_id, 'research-')")
_MULTI = " UNION ALL ".join(f"SELECT key, part, content_state, '{c}' AS category_id FROM y WHERE {f}" for c, f in zip(hierarchy.CATEGORIES, _FLAGS))
_LOG = "g AS (SELECT event_id, ts, user_id, event_type AS kind, 'w' || CAST(event_id % 23 AS VARCHAR) AS work, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE props END AS value FROM events)"
_REFS = "z AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Order ' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || CASE l_partkey % 4 WHEN 0 THEN '-' || CAST(l_linenumber + 3 AS VARCHAR) WHEN 1 THEN ',' || CAST(l_linenumber + 2 AS VARCHAR) WHEN 2 THEN '0' ELSE '' END AS reference FROM lineitem)"
_CROSS = "q AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS chapter, CAST(l_linenumber % 3 AS VARCHAR) AS verse, 'part ' || CAST(l_partkey AS VARCHAR) AS anchor, 'see ' || CAST(l_partkey % 40 AS VARCHAR) AS reference, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"
_CHECK = f"WITH {_WORKS}, v AS (SELECT key, content_state, CASE WHEN work_index % 13 <> 0 THEN key END AS reader_path, CASE WHEN work_index % 5 = 0 THEN 'ftp://x' ELSE 'https://x' END AS source_url, content_state = 'local-readable' OR key LIKE '%7' AS held FROM w), e AS (SELECT 'readable-has-payload' AS rule, key AS subject, '' AS detail FROM v WHERE content_state = 'local-readable' AND (NOT held OR reader_path IS NULL) UNION ALL SELECT 'others-have-none', key, '' FROM v WHERE content_state <> 'local-readable' AND (held OR reader_path IS NOT NULL) UNION ALL SELECT 'source-url', key, source_url FROM v WHERE content_state = 'source-readable' AND NOT regexp_matches(source_url, '^https?://'))"
# an event goes if a removal that came after it found the work imported
_LEFT = "i AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, work ORDER BY ts, event_id) AS before FROM g WHERE kind IN ('error', 'signup')), gone AS (SELECT user_id, work, ts, event_id FROM i WHERE kind = 'error' AND before = 'signup'), left_events AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.user_id = g.user_id AND gone.work = g.work AND (gone.ts, gone.event_id) >= (g.ts, g.event_id)))"
_TOGGLE = "SELECT user_id, work, max(ts) AS created_at FROM g WHERE kind = 'click' GROUP BY ALL HAVING count(*) % 2 = 1"

ORACLES = {
    "study_context": "WITH l AS (SELECT CAST(l_orderkey % 97 AS VARCHAR) AS s, CAST(l_orderkey % 3 AS VARCHAR) AS c, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS f, l_partkey AS p, l_linenumber AS n FROM lineitem), r AS (SELECT s, c, 0 AS part, pos, 'study:bible:' || s || '|' || c || '|commentary-' || CAST(pos + 1 AS VARCHAR) AS id, CASE WHEN f = 'R' THEN 'Commentary' ELSE f END AS passage, 'part ' || CAST(p AS VARCHAR) AS text FROM l WHERE n = 1 AND p % 5 <> 0 UNION ALL SELECT s, c, 1, pos, 'study:bible:' || s || '|' || c || '|crossref-' || CAST(pos + 1 AS VARCHAR), f, 'Reference: ' || CAST(p AS VARCHAR) || ', x' FROM l WHERE n > 4), k AS (SELECT *, row_number() OVER (PARTITION BY s, c ORDER BY part, pos, text, passage) AS place FROM r) SELECT s AS study_id, c AS chapter, id, passage, text, CAST(place AS INTEGER) AS place FROM k WHERE place <= 12",
    "study_profiles": "SELECT CAST(p_partkey AS VARCHAR) AS study_id, 'study:reference:' || CAST(p_partkey AS VARCHAR) || '|profile|brand' AS id, 'brand' AS passage, p_brand AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'study:reference:' || CAST(p_partkey AS VARCHAR) || '|profile|size', 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size <= 25",
    "study_mapping": "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'bible' ELSE 'reference' END END AS kind, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN n_name WHEN n_nationkey < 15 THEN lower(n_name) END END AS title FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "work_extraction": "SELECT replace(p_brand, '#', '-') || '/' || CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 7 = 0 THEN 'local-readable' WHEN p_partkey % 3 = 0 THEN 'bibliographic' WHEN p_partkey % 3 = 1 THEN 'source-readable' ELSE 'catalog-only' END AS content_state, CASE WHEN p_partkey % 2 = 0 THEN 'http://a' ELSE 'http://z' END AS source_url, CASE WHEN p_partkey % 7 = 0 THEN 'books/' || replace(p_brand, '#', '-') || '/' || CAST(p_partkey AS VARCHAR) || '.json' END AS reader_path, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS work_index FROM part",
    "work_integration": "SELECT s_name AS key, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) END + row_number() OVER (PARTITION BY s_suppkey % 2 = 0 ORDER BY s_nationkey, s_suppkey) - 1 AS BIGINT) AS work_index FROM supplier",
    "acquisition_report": "SELECT conv_id, count(DISTINCT role) AS chapters, count(*) AS segments, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS sha256 FROM conversations GROUP BY conv_id",
    "companion_records": "SELECT 'c' || CAST(l_orderkey AS VARCHAR) AS id, 'w/' || CAST(l_suppkey + 5 AS VARCHAR) AS companion_work, p_name AS companion_title FROM lineitem LEFT JOIN part ON p_partkey = l_suppkey + 5 AND p_partkey <> 7 WHERE l_linenumber = 1 AND l_partkey % 50 = 10",
    "classify_default": f"""WITH {_WORKS} SELECT key, CASE WHEN rg IS NOT NULL AND NOT bible THEN 'restoration' WHEN jg IS NOT NULL AND NOT bible THEN 'jewish' WHEN apo THEN 'apocrypha' WHEN pse THEN 'pseudepigrapha' WHEN gno THEN 'gnostic' WHEN section = 'Hymns & Songs' THEN 'hymns' WHEN early THEN 'early-christian' WHEN eth THEN 'ethiopian' WHEN bible AND part = 'nt' THEN 'new-testament' WHEN bible AND part = 'other' THEN 'apocrypha' WHEN bible THEN 'hebrew-bible' WHEN content_state <> 'local-readable' THEN 'sources' ELSE 'hebrew-bible' END AS category,
CASE WHEN rg IS NOT NULL AND NOT bible THEN rg WHEN jg IS NOT NULL AND NOT bible THEN jg WHEN apo THEN 'christian-apocrypha' WHEN pse THEN CASE WHEN eno THEN 'enochic' ELSE 'other-pseudepigrapha' END WHEN gno OR section = 'Hymns & Songs' OR early OR eth THEN '' WHEN bible AND part = 'other' THEN 'biblical-apocrypha' ELSE '' END AS "group" FROM y""",
    "classify_multilabel": f"WITH {_WORKS} SELECT key, part, category_id FROM ({_MULTI})",
    "category_summary": f"WITH {_WORKS} SELECT category_id, count(*) AS records, count(*) FILTER (content_state = 'local-readable') AS readable FROM ({_MULTI}) GROUP BY 1",
    "group_records": f"""WITH {_WORKS} SELECT 'restoration' AS category, 'utah-lds' AS "group", key FROM y WHERE rg = 'utah-lds' AND (edition_id <> 'kjv' OR part <> 'other') UNION ALL SELECT 'pseudepigrapha', 'enochic', key FROM y WHERE pse AND eno UNION ALL SELECT 'apocrypha', 'biblical-apocrypha', key FROM y WHERE bible AND part = 'other'""",
    "acquisition_works": f"WITH {_WORKS} SELECT key, edition_id FROM w WHERE regexp_matches(edition_title, '(?i)\\bSource Pack\\b') OR edition_id = 'christian-apocrypha-open-i'",
    "distinct_first_seen": "SELECT lang, min(doc_id) AS first_seen FROM documents GROUP BY lang ORDER BY first_seen",
    "shelf_summary": "SELECT source, count(*) AS records, count(*) FILTER (quality = 1) AS readable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "state_histogram_zero_filled": f"SELECT k.event_type, count(e.event_id) AS n FROM (SELECT unnest({_list(EVENT_KINDS)}) AS event_type) k LEFT JOIN events e ON e.event_type = k.event_type GROUP BY 1",
    "dense_index": "SELECT c_custkey, n_name, row_number() OVER (ORDER BY n_name, c_custkey) - 1 AS work_index FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "edition_rollup": "SELECT p_brand AS edition_id, count(*) AS book_count, CAST(sum(p_size) AS BIGINT) AS chapter_count, CAST(sum(p_partkey % 10) AS BIGINT) AS verse_count FROM part GROUP BY 1",
    "upsert_works": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'new ' || s_name END AS s_name, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 THEN 'has' ELSE 'given' END AS url FROM supplier",
    "mapping_coverage": "SELECT count(*) AS library_books, count(l.doc_id) AS mapped_books, round(100.0 * count(l.doc_id) / count(*), 2) AS percent FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
    "mapping_kinds": "SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS kind, count(*) AS n FROM labels GROUP BY 1",
    "works_with_editions": "SELECT c_custkey, coalesce(n_name, 'Unknown edition') AS edition FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0",
    "backlinks_prefix": f"WITH {_REFS}, t AS (SELECT 'order ' || CAST(o_orderkey AS VARCHAR) || ':1' AS target, o_orderkey FROM orders WHERE o_orderkey % 5 = 0) SELECT l_orderkey, l_linenumber, reference, target FROM z JOIN t ON z.l_orderkey = t.o_orderkey WHERE lower(reference) = target OR starts_with(lower(reference), target || '-') OR starts_with(lower(reference), target || ',')",
    "xref_invert": "SELECT l_partkey, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_orderkey, l_linenumber) AS sources FROM lineitem GROUP BY 1",
    "parallel_passages": f"WITH {_CROSS} SELECT reference, arg_min(anchor, pos) AS anchor, min(pos) AS pos FROM q WHERE chapter = '7' AND verse = '2' GROUP BY reference",
    "references_by_verse": f"WITH {_CROSS} SELECT chapter, verse, min(pos) AS first_pos, CAST(count(*) AS INTEGER) AS n FROM q GROUP BY chapter, verse",
    "orphan_anti": "SELECT 'line-has-order' AS rule, CAST(l_orderkey AS VARCHAR) AS subject, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 2",
    "fk_violations": "SELECT 'mapping-has-work' AS rule, CAST(doc_id AS VARCHAR) AS subject, '' AS detail FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'work-has-mapping', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duplicate_keys": "SELECT 'unique-event' AS rule, CAST(user_id AS VARCHAR) || '|' || event_type AS subject, CAST(count(*) AS VARCHAR) AS detail FROM events GROUP BY user_id, event_type HAVING count(*) > 1",
    "work_validation": f"{_CHECK} SELECT * FROM e",
    "validation_verdict": f"{_CHECK} SELECT count(*) AS errors, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM e",
    "last_position": f"WITH {_LOG} SELECT user_id, work, arg_max(value, (ts, event_id)) AS value FROM g WHERE kind = 'view' GROUP BY ALL",
    "bookmark_toggle": f"WITH {_LOG} {_TOGGLE}",
    "highlight_toggle": f"WITH {_LOG} SELECT user_id, work, max(ts) AS created_at, CASE WHEN arg_max(event_id, (ts, event_id)) % 2 = 0 THEN 'gold' ELSE 'blue' END AS value FROM g WHERE kind = 'purchase' GROUP BY ALL HAVING count(*) % 2 = 1",
    "note_last_write": f"WITH {_LOG} SELECT user_id, work, arg_max(value, (ts, event_id)) AS value FROM g WHERE kind = 'signup' GROUP BY ALL HAVING trim(arg_max(value, (ts, event_id))) <> ''",
    "history_dedup_cap": f"WITH {_LOG}, m AS (SELECT user_id, work, kind, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS e FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, e DESC) AS place FROM m) SELECT user_id, work, kind, ts, CAST(place AS INTEGER) AS place FROM r WHERE place <= 100",
    "import_cascade_delete": f"WITH {_LOG}, {_LEFT} SELECT user_id, work, max(ts) AS created_at FROM left_events WHERE kind = 'click' GROUP BY ALL HAVING count(*) % 2 = 1",
    "import_then_reimport": f"WITH {_LOG}, {_LEFT}, m AS (SELECT user_id, work, max((ts, event_id)) AS latest FROM left_events WHERE kind = 'view' GROUP BY ALL) SELECT user_id, work, latest[1] AS ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY latest DESC) AS INTEGER) AS place FROM m QUALIFY place <= 100",
    "plan_progress": "WITH p AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, l_returnflag = 'R' AS c FROM lineitem), s AS (SELECT id, CAST(count(*) FILTER (c OR (id = 1 AND k = 1)) AS INTEGER) AS done, CAST(count(*) AS INTEGER) AS steps FROM p GROUP BY id) SELECT id, done, steps, round(100.0 * done / steps) AS percent FROM s",
    "collection_replace": "SELECT l_orderkey, l_linenumber, 'old' AS note FROM lineitem WHERE l_linenumber <= 2 AND NOT (l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)) UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderkey % 3 = 0",
    "annotated_chapter": f"WITH {_LOG}, s AS (SELECT DISTINCT user_id, work FROM g), b AS ({_TOGGLE}), c AS (SELECT user_id, work, CASE WHEN coalesce(arg_max(value, (ts, event_id)), '') = '' THEN 'gold' ELSE arg_max(value, (ts, event_id)) END AS colour FROM g WHERE kind = 'purchase' GROUP BY ALL HAVING count(*) % 2 = 1), n AS (SELECT user_id, work, arg_max(value, (ts, event_id)) AS note FROM g WHERE kind = 'signup' GROUP BY ALL HAVING trim(arg_max(value, (ts, event_id))) <> '') SELECT s.user_id, s.work, b.created_at IS NOT NULL AS bookmarked, c.colour, n.note FROM s LEFT JOIN b USING (user_id, work) LEFT JOIN c USING (user_id, work) LEFT JOIN n USING (user_id, work)",
    "sources_listing": f"WITH {_WORKS} SELECT key, content_state FROM w WHERE content_state <> 'local-readable' ORDER BY work_index LIMIT 250",
    "titles_in_order": "SELECT DISTINCT p_name AS title FROM part ORDER BY title",
}
