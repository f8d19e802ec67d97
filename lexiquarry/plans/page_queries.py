"""Whole pages of a reader as one query each: comparison, links, lists, browsing, validation, passages and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, build, crossrefs, hierarchy, search, state, validate
from ..sources import books
from . import state_queries
from .catalog_queries import _MULTI, _REFS, _WORKS, _groups, _references, works
from .text_queries import _FOUND, _SIDES, QUESTION, documents, table


def compare_editions(spark, d):
    """Conversations as works in two editions, what users said and what assistants said, four turns a chapter; every pair, passage by passage, with each token's mark. Whole texts are compared, so truncated is false where there are marks."""
    rows = table(spark, d, "conversations")
    key = F.concat(F.col("role"), F.lit("/"), F.col("conv_id"))
    n = F.floor(F.col("turn") / 2)
    segments = rows.filter("role IN ('user', 'assistant')").select(key.alias("key"), F.floor(n / 2).cast("string").alias("chapter"), (n % 2).cast("long").alias("idx"), F.lit(None).cast("string").alias("label"), "text")
    # letters stand for the digits, for titles' filler words go but letters stay
    titles = rows.filter("role IN ('user', 'assistant')").select(key.alias("key"), F.concat(F.lit("The Book of "), F.translate(F.col("conv_id").cast("string"), "0123456789", "bcdfghjklm")).alias("title"), F.col("conv_id").alias("work_index"), F.lit("local-readable").alias("content_state")).distinct()
    pairs = align.first_related(align.with_identity(titles, "title"))
    marks = lambda s: F.array_join(F.transform(F.col(f"diff.{s}"), lambda x: F.concat(F.when(x["kept"], "=").otherwise("~"), x["token"])), " ")
    return align.compared(pairs, segments).select("primary", "secondary", "chapter", "label", "primary_index", "secondary_index", "different", F.md5(F.encode(marks("left"), "UTF-8")).alias("left_marks"), F.md5(F.encode(marks("right"), "UTF-8")).alias("right_marks"), F.col("diff.cut").alias("truncated"))


def passage_links(spark, d):
    """Every order as a passage: the references that point at it, and the notes and bookmarks on it."""
    passages = table(spark, d, "orders").select(F.concat(F.lit("w"), F.col("o_orderkey") % 5).alias("work"), (F.col("o_orderkey") % 2).alias("chapter"), F.concat(F.lit("p"), F.col("o_orderkey") % 40).alias("passage"), F.concat(F.lit("Order  "), "o_orderkey", F.lit(":1")).alias("target"))
    k = F.col("event_id")
    items = table(spark, d, "events").filter("event_type IN ('signup', 'click')").select(F.concat(F.lit("w"), k % 5).alias("work"), (k % 2).cast("string").alias("chapter"), F.concat(F.lit("p"), k % 97).alias("passage"), F.when(F.col("event_type") == "signup", "note").otherwise("bookmark").alias("type"), F.col("user_id").cast("string").alias("source"), F.when(F.col("event_type") == "signup", F.col("props")).alias("text"))
    links = _references(spark, d).select(F.col("l_partkey").cast("string").alias("source"), "reference")
    return crossrefs.passage_links(links, passages, items)


def library_lists(spark, d):
    """Every reader's lists by recency, the last thirty visits among them."""
    titles = table(spark, d, "part").filter("p_partkey <> 3").select(F.concat(F.lit("w"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("edition_title"))
    rows = state.library_lists(state_queries.reader_state(spark, d), titles)
    return rows.select("user_id", "kind", F.col("place").cast("long").alias("place"), "work", "chapter", "passage", "value", "ts", "work_title", "work_edition")


def browse(spark, d):
    return hierarchy.browsed(works(spark, d), _groups(spark)).select("category_id", "edition_id", "edition", "records", "readable", F.col("place").cast("long").alias("place"), "key", "title")


def validation_run(spark, d):
    """Orders as works: payloads that are missing, broken or blank by rule, mappings, numbers that are off, and a manifest."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.concat(F.lit("w/"), k).alias("key"), F.when(k % 3 == 0, "local-readable").when(k % 3 == 1, "source-readable").when(k % 50 == 2, "odd").otherwise("bibliographic").alias("content_state"))
    index = rows.select("key", "content_state", F.when(k % 3 == 0, F.when(k % 21 != 0, F.col("key"))).alias("reader_path"), F.when(k % 8 != 1, F.lit("HTTPS://x")).otherwise("ftp:x").alias("source_url"))
    content = F.when(k % 33 == 0, "[").when(k % 39 == 0, '{"chapters":{"1":[{"text":"a"},{"text":" "}]}}').otherwise('{"chapters":{"1":[{"text":"a"}]}}')
    files = rows.filter((k % 3 == 0) & (k % 27 != 0)).select("key", content.alias("content"))
    segments = table(spark, d, "lineitem").select(F.concat(F.lit("w/"), "l_orderkey").alias("work_key"), F.lit("1").alias("chapter"), F.col("l_linenumber").alias("seg_idx"), F.when(F.col("l_partkey") % 200 == 0, "  ").otherwise("text").alias("text"))
    mapping = rows.filter((k % 3 == 0) & (k % 15 != 0) | (k % 100 == 1)).select(F.col("key").alias("work_key"))
    said = validate.counts(segments).withColumn("n", F.when(F.col("name").endswith("77"), F.col("n") + 1).otherwise(F.col("n")))
    return validate.validated(index, files, segments, mapping, {"works": -1, "segments": -2}, said)


def retrieve_titles(spark, d):
    """The best passages for a question, with their works' titles and editions."""
    titled = table(spark, d, "part").select(F.col("p_partkey").alias("work_index"), F.concat(F.lit("w/"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("edition_title"))
    hits = search.retrieve(documents(spark, d).withColumn("work_index", F.col("doc_id")), QUESTION, ["doc_id"])
    return search.with_works(hits, titled).select("doc_id", F.col("score").cast("long").alias("score"), "work_key", "work_title", "edition_title")


def prompt_of_texts(spark, d):
    """Prompts of each conversation, with the texts of the table under the byte budget."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat_ws(".", "conv_id", "turn").alias("id"), "turn", "text", F.col("role").alias("kind"), F.concat(F.lit("Turn "), "turn").alias("title"))
    made = search.prompts(rows, " What is it? ", ["conv_id"], ["turn"])
    return made.select("conv_id", F.md5(F.encode("prompt", "UTF-8")).alias("digest"), F.octet_length("prompt").cast("long").alias("bytes"), F.array_join("ids", ",").alias("ids"))


def work_records(spark, d):
    """Parts as a catalogue's books, a brand an edition: states, paths, counts, and the old fields in one column."""
    k = F.col("p_partkey")
    one_of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    catalogue = table(spark, d, "part").select(
        F.translate("p_brand", "#", "-").alias("edition_id"), F.col("p_brand").alias("edition_ord"), F.col("p_brand").alias("edition_title"), F.when(k % 4 == 0, "").otherwise("Collection").alias("collection_label"), F.when(k % 6 == 0, "https://e").alias("edition_reader_url"), F.lit("https://s").alias("edition_url"),
        k.cast("string").alias("id"), k.alias("book_ord"), F.when(k % 5 != 0, F.col("p_name")).alias("title"), F.when(k % 7 != 0, F.col("p_type")).otherwise("").alias("name"), F.col("p_size").alias("chapters"), F.when(k % 3 != 0, k).alias("verses"), F.when(k % 8 == 0, "").alias("reader_url"), F.when(k % 9 == 0, "https://b").alias("source_url"),
        one_of("source-only", "bibliographic-only", "other", None).alias("reader_availability"), F.lit(True).alias("bundled_json"), (k % 2 == 0).alias("local_mirror"), F.col("p_type").alias("availability"), F.lit(False).alias("searchable"),
    )
    local = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().join(table(spark, d, "part"), "p_partkey").select(F.concat_ws("/", F.translate("p_brand", "#", "-"), "p_partkey").alias("key"))
    rows = build.work_records(catalogue, local)
    return rows.select(*(c for c in rows.columns if c not in ("work_index", "legacy_reference")), F.col("work_index").cast("long").alias("work_index"), F.concat_ws("|", "legacy_reference.reader_availability", F.col("legacy_reference.local_mirror").cast("string"), "legacy_reference.availability").alias("legacy"))


def asset_extraction(spark, d):
    """Pages as images in data URLs: their paths, kinds, sizes and digests."""
    k = F.col("page_id")
    kind = F.element_at(F.array(F.lit("webp"), F.lit("png"), F.lit("svg+xml")), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "pages").filter("html <> ''").select(F.concat(F.lit("art "), k, F.when(k % 2 == 0, ".x.jpg").otherwise("")).alias("name"), F.concat(F.when(k % 5 == 0, "DATA:image/").otherwise("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "")).alias("url"))
    return books.assets(rows).select("name", "path", "mime_type", F.col("bytes").cast("long").alias("bytes"), "sha256")


NAMES = ("compare_editions", "passage_links", "library_lists", "browse", "validation_run", "retrieve_titles", "prompt_of_texts", "work_records", "asset_extraction")
QUERIES = {n: globals()[n] for n in NAMES}

_COMPARED = r"""c AS (SELECT conv_id, role || '/' || CAST(conv_id AS VARCHAR) AS key, role, CAST(turn // 4 AS VARCHAR) AS chapter, (turn // 2) % 2 AS idx, text FROM conversations WHERE role IN ('user', 'assistant')),
  k AS (SELECT conv_id, chapter FROM c GROUP BY ALL HAVING count(DISTINCT role) = 2),
  s AS (SELECT c.* FROM c JOIN k USING (conv_id, chapter)),
  a AS (SELECT p.key AS one, o.key AS other, p.chapter, coalesce(p.idx, q.idx) AS pos, p.idx AS primary_index, q.idx AS secondary_index, p.text AS lt, q.text AS rt
    FROM s p JOIN (SELECT DISTINCT conv_id, key FROM s) o ON o.conv_id = p.conv_id AND o.key <> p.key LEFT JOIN s q ON q.key = o.key AND q.chapter = p.chapter AND q.idx = p.idx
    UNION ALL SELECT o.key, q.key, q.chapter, q.idx, NULL, q.idx, NULL, q.text FROM s q JOIN (SELECT DISTINCT conv_id, key FROM s) o ON o.conv_id = q.conv_id AND o.key <> q.key
      WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.key = o.key AND p.chapter = q.chapter AND p.idx = q.idx)),
  e AS (SELECT *, row_number() OVER (ORDER BY one, other, chapter, pos) AS id, lower(trim(regexp_replace(coalesce(lt, ''), '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(coalesce(rt, ''), '\s+', ' ', 'g'))) AS different FROM a)"""
# tokens of sides(id, lt, rt) with marks: the longest common subsequence row by row from the end, then the walk from the front
_MARKED = r"""t AS MATERIALIZED (SELECT id, lw[:250] AS lw, rw[:250] AS rw, [regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') FOR x IN lw[:250]] AS l, [regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') FOR x IN rw[:250]] AS r, len(lw) > 250 OR len(rw) > 250 AS cut
    FROM (SELECT id, regexp_extract_all(lt, '[\p{L}\p{N}''’]+|[^\s\p{L}\p{N}''’]+') AS lw, regexp_extract_all(rt, '[\p{L}\p{N}''’]+|[^\s\p{L}\p{N}''’]+') AS rw FROM sides)),
  dp AS (SELECT id, len(l) AS i, list_resize([0], len(r) + 1, 0) AS rest FROM t
    UNION ALL SELECT id, i - 1, list_reverse(list_reduce(list_prepend([0], list_reverse([[CASE WHEN l[i] <> '' AND r[j] = l[i] THEN rest[j + 1] + 1 ELSE rest[j] END] FOR j IN range(1, len(r) + 1)])), lambda acc, x: list_append(acc, greatest(x[1], acc[-1])))) FROM dp JOIN t USING (id) WHERE i > 0),
  rows AS MATERIALIZED (SELECT * FROM dp),
  w AS (SELECT id, 1 AS i, 1 AS j, '' AS lm, '' AS rm FROM t
    UNION ALL SELECT id, CASE step WHEN 'right' THEN i ELSE i + 1 END, CASE step WHEN 'left' THEN j ELSE j + 1 END, CASE step WHEN 'both' THEN lm || '=' WHEN 'left' THEN lm || '~' ELSE lm END, CASE step WHEN 'both' THEN rm || '=' WHEN 'right' THEN rm || '~' ELSE rm END
    FROM (SELECT w.*, CASE WHEN w.i <= len(l) AND j <= len(r) AND l[w.i] <> '' AND l[w.i] = r[j] THEN 'both' WHEN j <= len(r) AND (w.i > len(l) OR x.rest[j + 1] >= y.rest[j]) THEN 'right' ELSE 'left' END AS step
      FROM w JOIN t USING (id) LEFT JOIN rows x ON x.id = w.id AND x.i = w.i - 1 LEFT JOIN rows y ON y.id = w.id AND y.i = w.i WHERE w.i <= len(l) OR w.j <= len(r)) AS n),
  m AS (SELECT w.id, cut, [lm[g] || lw[g] FOR g IN range(1, len(lw) + 1)] AS lt, [rm[g] || rw[g] FOR g IN range(1, len(rw) + 1)] AS rt FROM w JOIN t USING (id) WHERE i > len(l) AND j > len(r))"""

# the same for all tokens
_ALL_MARKED = _MARKED.replace("[:250]", "").replace("len(lw) > 250 OR len(rw) > 250 AS cut", "false AS cut")

ORACLES = {
    "compare_editions": f"""WITH RECURSIVE {_COMPARED}, sides AS (SELECT id, lt, rt FROM e WHERE different AND coalesce(lt, '') <> '' AND coalesce(rt, '') <> ''), {_ALL_MARKED} SELECT one AS "primary", other AS secondary, chapter, CAST(pos + 1 AS VARCHAR) AS label, primary_index, secondary_index, different, md5(array_to_string(m.lt, ' ')) AS left_marks, md5(array_to_string(m.rt, ' ')) AS right_marks, cut AS truncated FROM e LEFT JOIN m USING (id)""",
    "word_diff": f"""WITH RECURSIVE {_SIDES.format(label="CAST(NULL AS VARCHAR)")}, e AS (SELECT r.*, q.text AS secondary_text, row_number() OVER (ORDER BY r.conv_id, primary_index, secondary_index) AS id FROM r LEFT JOIN s q ON r.conv_id = q.conv_id AND r.secondary_index = q.idx),
      sides AS (SELECT id, coalesce(primary_text, '') AS lt, coalesce(secondary_text, '') AS rt FROM e), {_MARKED}
      SELECT conv_id, label, primary_index, secondary_index, CAST(len(list_filter(m.lt, lambda x: x[1] = '~')) AS INTEGER) AS left_changed, CAST(len(list_filter(m.rt, lambda x: x[1] = '~')) AS INTEGER) AS right_changed, cut AS truncated FROM e JOIN m USING (id)""",
    "passage_links": f"""WITH {_REFS}, p AS (SELECT 'w' || CAST(o_orderkey % 5 AS VARCHAR) AS work, CAST(o_orderkey % 2 AS VARCHAR) AS chapter, 'p' || CAST(o_orderkey % 40 AS VARCHAR) AS passage, o_orderkey FROM orders)
      SELECT work, chapter, passage, 'cross-reference' AS type, CAST(l_partkey AS VARCHAR) AS source, reference AS said FROM z JOIN p ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_partkey % 4 <> 2
      UNION ALL SELECT work, chapter, passage, CASE event_type WHEN 'signup' THEN 'note' ELSE 'bookmark' END, CAST(user_id AS VARCHAR), CASE event_type WHEN 'signup' THEN props END FROM events JOIN (SELECT DISTINCT work, chapter, passage FROM p) q ON work = 'w' || CAST(event_id % 5 AS VARCHAR) AND chapter = CAST(event_id % 2 AS VARCHAR) AND passage = 'p' || CAST(event_id % 97 AS VARCHAR) WHERE event_type IN ('signup', 'click')""",
    "library_lists": f"""WITH s0 AS ({state_queries.ORACLES["reader_state"]}), r AS (SELECT s0.*, p_name AS work_title, p_brand AS work_edition FROM s0 JOIN part ON work = 'w' || CAST(p_partkey AS VARCHAR) WHERE p_partkey <> 3)
      SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, work, chapter, passage) AS place FROM r QUALIFY kind <> 'visit' OR place <= 30""",
    "browse": f"""WITH {_WORKS}, m AS ({_MULTI}), b AS (SELECT category_id, edition_id, CASE WHEN edition_title LIKE 'Source Pack %' THEN replace(edition_title, 'Source Pack ', 'Collection ') ELSE edition_title END AS edition, w.key, title, w.content_state FROM m JOIN w USING (key))
      SELECT category_id, edition_id, edition, count(*) OVER s AS records, count(*) FILTER (content_state = 'local-readable') OVER s AS readable, row_number() OVER (PARTITION BY category_id, edition_id ORDER BY title, key) AS place, key, title FROM b WINDOW s AS (PARTITION BY category_id, edition_id)""",
    "validation_run": r"""WITH o AS (SELECT o_orderkey AS k, 'w/' || CAST(o_orderkey AS VARCHAR) AS key FROM orders), n AS (SELECT 'w/' || CAST(l_orderkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT 'state-domain' AS rule, key AS subject, 'odd' AS detail FROM o WHERE k % 3 = 2 AND k % 50 = 2
      UNION ALL SELECT 'readable-has-payload', key, '' FROM o WHERE k % 3 = 0 AND (k % 27 = 0 OR k % 21 = 0)
      UNION ALL SELECT 'source-url', key, 'ftp:x' FROM o WHERE k % 3 = 1 AND k % 8 = 1
      UNION ALL SELECT 'work-has-payload', key, '' FROM o WHERE k % 27 = 0
      UNION ALL SELECT 'payload-is-json', key, '' FROM o WHERE k % 33 = 0 AND k % 27 <> 0
      UNION ALL SELECT 'segment-has-text', key || '|1|2', '' FROM o WHERE k % 39 = 0 AND k % 33 <> 0 AND k % 27 <> 0
      UNION ALL SELECT 'blank-text', 'w/' || CAST(l_orderkey AS VARCHAR) || '|1|' || CAST(l_linenumber AS VARCHAR), '' FROM lineitem WHERE l_partkey % 200 = 0
      UNION ALL SELECT 'mapping-has-work', key, '' FROM o WHERE k % 100 = 1 AND k % 3 <> 0
      UNION ALL SELECT 'work-has-mapping', key, '' FROM o WHERE k % 15 = 0 AND k % 100 <> 1
      UNION ALL SELECT 'count', 'works', CAST(count(*) AS VARCHAR) FROM o UNION ALL SELECT 'count', 'segments', CAST(count(*) AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'manifest-count', name, 'said ' || CAST(n + 1 AS VARCHAR) || ', found ' || CAST(n AS VARCHAR) FROM n WHERE name LIKE '%77'""",
    "retrieve_titles": f"""WITH h AS (SELECT doc_id, CAST(score AS BIGINT) AS score FROM (SELECT doc_id, 3 * ({_FOUND}) + CASE WHEN contains(lower(text), '{QUESTION.lower()}') THEN 8 ELSE 0 END AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 18)
      SELECT doc_id, score, 'w/' || CAST(p_partkey AS VARCHAR) AS work_key, p_name AS work_title, p_brand AS edition_title FROM h JOIN part ON p_partkey = doc_id""",
    "prompt_of_texts": r"""WITH o AS (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations), w AS (SELECT *, least(5000, octet_length(encode(t))) AS want FROM o WHERE ordinal <= 24 AND t <> ''),
      b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), c AS (SELECT *, CAST(least(want, 36000 - before) AS BIGINT) AS most FROM b WHERE before < 36000),
      k AS (SELECT *, CASE WHEN octet_length(encode(t)) <= most THEN t ELSE left(t, list_max([n FOR n IN range(0, most + 1) IF octet_length(encode(left(t, n))) <= most])) END AS cut FROM c),
      p AS (SELECT conv_id, 'QUESTION:' || chr(10) || 'What is it?' || chr(10) || chr(10) || 'LOCAL CONTEXT:' || chr(10) || string_agg(chr(10) || '[' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '] (' || role || ') Turn ' || CAST(turn AS VARCHAR) || chr(10) || cut || chr(10), '' ORDER BY turn) AS prompt, string_agg(CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS ids FROM k WHERE cut <> '' GROUP BY conv_id)
      SELECT conv_id, md5(prompt) AS digest, octet_length(encode(prompt)) AS bytes, ids FROM p""",
    "work_records": r"""WITH p AS (SELECT *, p_partkey AS k, replace(p_brand, '#', '-') AS e, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AS here FROM part),
      s AS (SELECT *, CASE WHEN here THEN 'local-readable' WHEN k % 4 = 0 THEN 'source-readable' WHEN k % 4 = 1 THEN 'bibliographic' ELSE 'catalog-only' END AS content_state FROM p)
      SELECT e || '/' || CAST(k AS VARCHAR) AS key, e AS edition_id, p_brand AS edition_title, CASE WHEN k % 4 = 0 THEN p_brand ELSE 'Collection' END AS collection_label, CAST(k AS VARCHAR) AS book_id, CASE WHEN k % 5 <> 0 THEN p_name ELSE nullif(CASE WHEN k % 7 <> 0 THEN p_type END, '') END AS title,
        CASE WHEN k % 7 <> 0 THEN p_type WHEN k % 5 <> 0 THEN p_name END AS name, content_state, CASE WHEN here THEN 'books/' || e || '/' || CAST(k AS VARCHAR) || '.json' END AS reader_path, CASE WHEN k % 9 = 0 THEN 'https://b' WHEN k % 6 = 0 THEN 'https://e' ELSE 'https://s' END AS source_url, here AS searchable,
        CASE WHEN here THEN CAST(p_size AS BIGINT) ELSE 0 END AS section_count, CASE WHEN here AND k % 3 <> 0 THEN k ELSE 0 END AS segment_count, row_number() OVER (ORDER BY p_brand, k) - 1 AS work_index,
        CASE k % 4 WHEN 0 THEN 'source-only|' WHEN 1 THEN 'bibliographic-only|' WHEN 2 THEN 'other|' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '|' || p_type AS legacy FROM s""",
    "asset_extraction": r"""SELECT 'art ' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.x.jpg' ELSE '' END AS name, 'assets/art ' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.x.' || ['webp', 'png', 'svg+xml'][page_id % 3 + 1] ELSE '' END AS path,
      'image/' || ['webp', 'png', 'svg+xml'][page_id % 3 + 1] AS mime_type, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages WHERE html <> ''""",
}
