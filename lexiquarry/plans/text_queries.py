"""Search, retrieval, concordance, parsing and text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, udfs
from ..operators import align, blocks, repair, search
from ..sources import books

QUESTION = "What is the meaning of tion and there, and also the ea?"
WORD = "the"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def search_all_terms(spark, d):
    return search.search_all_terms(documents(spark, d), "the and", ["doc_id"]).select("doc_id", "lang", "source")


def search_union_imports(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("part"), "text")
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("part"), "text")
    return search.search_with_imports(docs, own, "the of", ["key", "part"]).select("imported", "key", "part")


def retrieve_scored_topk(spark, d):
    return search.retrieve(documents(spark, d), QUESTION, ["doc_id"]).select("doc_id", "score")


def chapter_context_fallback(spark, d):
    rows = table(spark, d, "conversations")
    return search.chapter_context(rows, QUESTION, ["conv_id"], ["turn", "role"]).select("conv_id", "turn", "role", "score", "place")


def grounding_priority_union(spark, d):
    docs = documents(spark, d).select(F.concat(F.lit("d"), F.col("doc_id") % 40).alias("id"), F.col("doc_id").alias("pos"), "text")
    marks = table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id") % 25).alias("id"), F.col("item_id").alias("pos"), "text")
    talk = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    return search.grounding([marks, docs, talk], ["pos"]).select("id", "producer", "pos")


def prompt_byte_budget(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"), "doc_id", "text")
    return search.prompt_budget(rows, ["source"], ["doc_id"]).select("source", "doc_id", "ordinal", "bytes")


def _prompt_rows(spark, d):
    return table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"), "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "note").alias("kind"), F.concat(F.lit("T"), "doc_id").alias("title"))


def prompt_texts(spark, d):
    return search.prompt_items(_prompt_rows(spark, d), ["source"], ["doc_id"]).select("source", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").alias("length"))


def prompt_bundles(spark, d):
    """Prompts of each source's first items with short texts, whole."""
    rows = _prompt_rows(spark, d).withColumn("text", F.concat(F.lit(" item "), "doc_id", F.lit("\n")))
    return search.prompts(rows, " What is it? ", ["source"], ["doc_id"]).select("source", "prompt", F.array_join("ids", ",").alias("ids"))


def _titled(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("work_index"), F.concat(F.lit("w/"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("edition_title"))


def _work_docs(spark, d):
    """Documents as passages of works that are parts; every seventh work is unknown."""
    return documents(spark, d).withColumn("work_index", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.floor(F.col("doc_id") / 4)).cast("long"))


def search_with_titles(spark, d):
    found = search.with_works(search.matches_all(_work_docs(spark, d), "the and"), _titled(spark, d))
    return found.select("doc_id", "work_key", "work_title", "edition_title")


def concordance_of_works(spark, d):
    return search.concordance_of_works(_work_docs(spark, d), _titled(spark, d), WORD).select("work_index", "work_title", "count")


def concordance_by_work(spark, d):
    return search.concordance_by_work(documents(spark, d), WORD, "source")


def concordance_hits(spark, d):
    return search.concordance_hits(documents(spark, d), WORD).select("doc_id", "source", "count")


def concordance_total(spark, d):
    return search.concordance_total(documents(spark, d), WORD)


def token_counts(spark, d):
    rows = documents(spark, d)
    return rows.select("doc_id", F.size(text.search_tokens(F.col("text"))).alias("search"), F.size(text.query_terms(F.col("text"))).alias("terms"), F.size(text.concordance_words(F.col("text"))).alias("words"), F.size(F.array_distinct(text.search_tokens(F.col("text")))).alias("kinds"))


def _indexed(spark, d):
    return documents(spark, d).withColumn("work_index", F.col("doc_id"))


def shard_stats(spark, d):
    return search.shard_stats(_indexed(spark, d))


def shard_tokens(spark, d):
    return search.shard_tokens(_indexed(spark, d)).groupBy("shard").agg(F.count(F.lit(1)).alias("tokens"))


def _tokens(spark, d):
    """All distinct tokens, and each of some with a character beyond the basic plane, which counts twice."""
    rows = documents(spark, d).select(F.explode(text.search_tokens(F.col("text"))).alias("token")).distinct()
    return rows.withColumn("token", F.explode(F.when(F.col("token").startswith("qu"), F.array(F.col("token"), F.concat(F.lit("\U0001d504"), "token"))).otherwise(F.array("token"))))


def token_fnv1a(spark, d):
    return _tokens(spark, d).select("token", hashing.fnv1a(F.col("token")).alias("hash"))


def token_times33(spark, d):
    return _tokens(spark, d).select("token", hashing.times33(F.col("token")).alias("hash"))


def bloom_shard_prune(spark, d):
    """Search within the shards that the bloom filters allow: the same rows as without them."""
    rows = _indexed(spark, d)
    near = search.shards_for(search.bloom_filters(search.shard_tokens(rows)), "the and")
    kept = rows.withColumn("shard", hashing.shard_of(F.col("work_index"))).join(near, "shard", "left_semi")
    return search.search_all_terms(kept, "the and", ["doc_id"]).select("doc_id")


def align_by_label(spark, d):
    rows = table(spark, d, "conversations")
    side = lambda role: rows.filter(F.col("role") == role).select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("idx"), F.when(F.col("turn") % 3 != 0, (F.floor(F.col("turn") / 2) + F.col("conv_id") % 2).cast("string")).alias("label"), "text")
    out = align.align(side("user"), side("assistant"), ["conv_id"])
    return out.select("conv_id", "label", "primary_index", "secondary_index")


def variant_rows(spark, d):
    """Aligned turns that differ once case and white space are evened out."""
    rows = table(spark, d, "conversations")
    side = lambda role: rows.filter(F.col("role") == role).select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("idx"), F.lit(None).cast("string").alias("label"), "text")
    out = align.align(side("user"), side("assistant"), ["conv_id"])
    return out.filter(align.differs("primary_text", "secondary_text")).select("conv_id", "label", "primary_index", "secondary_index")


def word_diff(spark, d):
    rows = table(spark, d, "conversations")
    side = lambda role: rows.filter(F.col("role") == role).select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("idx"), F.lit(None).cast("string").alias("label"), "text")
    out = align.with_diff(align.align(side("user"), side("assistant"), ["conv_id"]))
    changed = lambda s: F.size(F.filter(F.col(f"diff.{s}"), lambda x: ~x["kept"]))
    return out.select("conv_id", "label", "primary_index", "secondary_index", changed("left").alias("left_changed"), changed("right").alias("right_changed"), F.col("diff.cut").alias("truncated"))


def common_chapters(spark, d):
    rows = table(spark, d, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    side = lambda role: rows.filter(F.col("role") == role).select("conv_id", "pair").distinct()
    return align.common_chapters(side("user"), side("assistant"), ["conv_id", "pair"], ["conv_id", "pair"])


def _editions(spark, d):
    """Parts as works: those whose names are the same once filler words are gone."""
    parts = table(spark, d, "part").select(F.concat(F.lit("p/"), "p_partkey").alias("key"), F.concat_ws(" of the ", "p_brand", "p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "bibliographic").otherwise("local-readable").alias("content_state"))
    return align.with_identity(parts, "title")


def edition_members(spark, d):
    return align.edition_members(_editions(spark, d)).select("identity", "key", "readable", "n_readable")


def edition_pairs(spark, d):
    """The editions beside one work."""
    return align.edition_pairs(_editions(spark, d), "p/69")


def blank_line_blocks(spark, d):
    docs = documents(spark, d).withColumn("text", F.regexp_replace("text", r"\.\n", ".\n\n"))
    return blocks.blank_line_blocks(blocks.lines_of(docs, "doc_id"), "doc_id").select("doc_id", "block", "first_line", "n_lines", F.length("text").alias("length"))


HEADING = r"^\S+( \S+){0,3}\z"


def heading_sections(spark, d):
    return blocks.heading_sections(blocks.lines_of(documents(spark, d), "doc_id"), "doc_id", HEADING)


def carried_sections(spark, d):
    return blocks.carried_sections(blocks.lines_of(documents(spark, d), "doc_id"), "doc_id", r"^\S+\z", r"^\S+( \S+){1,4}\z")


def txt_import(spark, d):
    docs = documents(spark, d).withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\n", "\n\n"), r"\n\n(\S+ \S+)\n\n", "\n\nChapter $1\n\n"))
    return blocks.txt_import(docs, "doc_id").select("doc_id", "chapter", "chapter_label", "passage", F.length("text").alias("length"))


def consecutive_groups(spark, d):
    rows = documents(spark, d).withColumn("hundred", F.floor(F.col("doc_id") / 100))
    return blocks.consecutive_groups(rows, ["hundred"], ["lang"], ["doc_id"]).select("doc_id", "lang", "group_no")


def payload_digest(spark, d):
    return repair.with_digest(documents(spark, d), "text").select("doc_id", "sha256", "bytes")


def footnote_repair(spark, d):
    fused = documents(spark, d).withColumn("text", F.regexp_replace("text", r"([.,])\s(\p{Lu})", "$1" + "17$2"))
    return repair.repair(fused).select("doc_id", "markers", "changed", "left_over")


def footnote_audit(spark, d):
    fused = documents(spark, d).withColumn("text", F.regexp_replace("text", r"([.,])\s(\p{Lu})", "$1" + "17$2"))
    return repair.audit(repair.repair(fused), "source")


def html_assignment_scan(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("<script>window.PAGE="), F.to_json(F.struct("page_id", "url")), F.lit(";</script>"), "html").alias("html"))
    out = books.embedded(pages, "page_id", "PAGE")
    return out.select("page_id", F.variant_get("value", "$.page_id", "long").alias("inner_id"), F.variant_get("value", "$.url", "string").alias("inner_url"))


def packed_payloads(spark, d):
    """Base64 of texts through the unpacker, every other one packed with gzip: what isn't gzip stays."""
    data = F.encode("text", "UTF-8")
    rows = documents(spark, d).select("doc_id", F.base64(F.when(F.col("doc_id") % 2 == 0, udfs.gzipped(data)).otherwise(data)).alias("b"))
    return books.packed(rows, "doc_id", "b").select("doc_id", F.md5("content").alias("digest"))


def entity_decode(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    return pages.select("page_id", F.length(udfs.plain_lines("t")).alias("length"))


def export_txt(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.lit(1).alias("chapter"), "turn", F.col("turn").cast("string").alias("label"), F.concat_ws(" ", "role", "text").alias("text"))
    out = books.export_txt(rows, "conv_id", "chapter", ["turn", "label"], "Conversation")
    return out.select("conv_id", F.md5("content").alias("digest"), F.octet_length("content").alias("bytes"))


def research_bundle(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", "notes").otherwise("items").alias("kind"), F.col("turn").alias("pos"), F.col("text").alias("body"))
    out = books.research_bundle(rows, "conv_id", "Bundle", "research-bundle/v1", "2024-01-01T00:00:00.000Z")
    return out.select("conv_id", F.size(F.from_json("bundle", "notes array<string>")["notes"]).alias("notes"), F.size(F.from_json("bundle", "items array<string>")["items"]).alias("items"))


def manifest(spark, d):
    return books.manifest(documents(spark, d), "doc_id", "text")


def corpus_totals(spark, d):
    lines = F.split("text", "\n", -1)
    return documents(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(lines)).alias("lines"), F.sum(F.size(F.filter(lines, lambda x: ~text.is_blank(x)))).alias("segments"))


def text_functions(spark, d):
    rows = table(spark, d, "part")
    n = F.col("p_name")
    return rows.select(
        "p_partkey", text.title_label(F.replace(n, F.lit(" "), F.lit("-"))).alias("label"), text.html_escape(F.concat(n, F.lit(" <&'\">"))).alias("escaped"), text.name_norm(n).alias("name"), text.compact(F.concat(F.lit("  a \t b "), n)).alias("compact"),
        text.citation(n, F.col("p_brand"), F.lit("Chapter 1"), F.col("p_size").cast("string"), "Library").alias("citation"), text.grouped_number(F.col("p_partkey") * 12345).alias("grouped"),
        text.reference_norm(F.concat(F.lit("Vol. "), n)).alias("reference"), text.safe_filename(F.concat(n, F.lit(": a/b"))).alias("file"), text.base_title(F.concat(F.lit("in/"), n, F.lit(".x.json"))).alias("base"),
        text.url_path(n).alias("path"), hashing.base36(hashing.fnv1a(n)).alias("id"))


def title_label(spark, d):
    n = F.concat(F.lit("o'neil (x) a.b_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-éa xÉb"))
    return table(spark, d, "part").select("p_partkey", text.title_label(n).alias("label"))


def alias_functions(spark, d):
    """Short forms of book names, and shown titles of editions."""
    names = F.array(*map(F.lit, ("Genesis", "The Psalms", "1 John", "2 Kings", "3 Unknown", " Acts ", "Jude")))
    edition = F.array(*map(F.lit, ("Source Pack IV", "Recovered Local Editions · Source-Readable Works 12", "Online Critical Pseudepigrapha · Original-Language Editions", "", "A  ·  · B")))
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.aliases(F.get(names, (k % 7).cast("int")), F.concat(F.lit("B"), k % 3)), "|").alias("aliases"), text.friendly_title(F.get(edition, (k % 5).cast("int")), F.concat(F.lit("ed-"), k)).alias("title"))


def diff_tokens(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.md5(F.encode(F.array_join(text.diff_tokens(F.col("text")), "|"), "UTF-8")).alias("digest"), F.size(text.diff_tokens(F.col("text"))).alias("n"))


def source_profile(spark, d):
    """Fifteen fields of provenance of parts: what a work lacks its edition or book says."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    or_none = lambda n, value: F.when(k % n != 0, value)
    work = F.struct(F.concat(F.lit("w/"), k).alias("key"), or_none(2, F.col("p_name")).alias("title"), or_none(3, F.lit("")).alias("edition_title"), none.alias("collection_label"), F.lit("local-readable").alias("content_state"), or_none(5, F.lit("http://w")).alias("source_url"))
    edition = F.struct(F.col("p_brand").alias("title"), F.lit("C").alias("collection_label"), or_none(2, F.lit("en")).alias("language"), F.lit("open").alias("rights"), none.alias("license"), F.lit("http://l").alias("license_url"), F.lit("E").alias("translator"))
    book = F.struct(or_none(4, F.lit("held")).alias("rights"), F.lit("CC").alias("license"), F.lit("").alias("license_url"), or_none(3, F.lit("B")).alias("translator"), none.alias("attribution"), F.lit("n").alias("source_note"), or_none(4, F.lit("book")).alias("title"), F.col("p_type").alias("name"), F.array(F.lit("m")).alias("manuscript_witnesses"), F.lit(None).cast("array<string>").alias("source_urls"))
    out = table(spark, d, "part").select("p_partkey", work.alias("work"), edition.alias("edition"), book.alias("book")).select("p_partkey", text.source_profile().alias("p"))
    return out.select("p_partkey", *(F.col(f"p.{c}").alias(c) for c in ("work_key", "title", "edition", "collection", "language", "content_state", "source_url", "rights", "license", "license_url", "translator", "attribution", "source_note")), F.array_join("p.manuscript_witnesses", ",").alias("manuscript_witnesses"), F.size("p.source_urls").alias("source_urls"))


def lexicon_key(spark, d):
    q = F.concat(F.when(F.col("p_partkey") % 2 == 0, "g").otherwise(" H 0"), F.col("p_partkey"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(""))
    k = text.strong_keys(q)
    return table(spark, d, "part").select("p_partkey", k["letter"].alias("letter"), k["plain"].alias("plain"), k["padded"].alias("padded"))


def _lookup(words: DataFrame, word: str) -> DataFrame:
    """The headword (name, pos) that is equal but for case, else the first twenty that start with the word."""
    exact = words.filter(F.lower("name") == word.lower()).orderBy("pos").limit(1)
    near = words.join(exact.select(F.lit(1).alias("hit")), F.lit(True), "left_anti").filter(F.lower("name").startswith(word.lower())).orderBy("pos").limit(20)
    return exact.unionByName(near).withColumn("asked", F.lit(word))


def dictionary_lookup(spark, d):
    """One word that is a headword and one that only starts some."""
    words = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return _lookup(words, "Red Widget").unionByName(_lookup(words, "s"))


NAMES = ("search_all_terms", "search_union_imports", "retrieve_scored_topk", "chapter_context_fallback", "grounding_priority_union", "prompt_byte_budget", "prompt_texts", "prompt_bundles", "search_with_titles", "concordance_of_works", "concordance_by_work", "concordance_hits", "concordance_total", "token_counts", "shard_stats", "shard_tokens", "token_fnv1a", "token_times33", "bloom_shard_prune", "align_by_label", "variant_rows", "word_diff", "common_chapters", "edition_members", "edition_pairs", "blank_line_blocks", "heading_sections", "carried_sections", "txt_import", "consecutive_groups", "payload_digest", "footnote_repair", "footnote_audit", "html_assignment_scan", "packed_payloads", "entity_decode", "export_txt", "research_bundle", "manifest", "corpus_totals", "text_functions", "title_label", "alias_functions", "diff_tokens", "source_profile", "lexicon_key", "dictionary_lookup")
QUERIES = {n: globals()[n] for n in NAMES}

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']{2,}')"
_TERMS = "['meaning', 'tion', 'there']"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_FOUND = " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{t}') AS INTEGER)" for t in ("meaning", "tion"))
_TOKENS = "t AS (SELECT DISTINCT unnest(" + _TOK + ") AS token FROM documents), a AS (SELECT token FROM t UNION ALL SELECT chr(120068) || token FROM t WHERE starts_with(token, 'qu'))"
_UNITS = "flatten([CASE WHEN c < 65536 THEN [c] ELSE [55296 + ((c - 65536) >> 10), 56320 + ((c - 65536) & 1023)] END FOR c IN [CAST(ord(substr(token, i, 1)) AS BIGINT) FOR i IN range(1, length(token) + 1)]])"
_HASH = f"WITH {_TOKENS} SELECT token, list_reduce(list_prepend(CAST(SEED AS BIGINT), {_UNITS}), lambda h, c: STEP) AS hash FROM a"
_FUSED = r"f AS (SELECT doc_id, source, regexp_replace(text, '([.,])\s(\p{Lu})', '\1' || '17' || '\2', 'g') AS t0 FROM documents)"


def _passes() -> str:
    """The passes without lookahead: what must follow is taken along, and each pass runs twice, as one match may take what the next one starts with."""
    ctes, last, counts = [], "t0", []
    for k, (find, tail, to) in enumerate([(r"([\p{L}.,;:!?“”‘’\)\]])(\d{1,3}[a-z]?)", r"([\p{Lu}“‘\[])", r"\1 [\2] \3"), (r"(?m)(^|[\s.!?;:])(\d{1,3}[a-z]?)", r"(\p{Lu}\p{Ll}|[“‘\[])", r"\1[\2] \3"), (r"(\p{L})(\d{2,3})", r"([123][A-Z]\.)", r"\1 [\2] \3")], 1):
        once = lambda t, p=find + tail, to=to: f"regexp_replace({t}, '{p}', '{to}', 'g')"
        n = lambda t, p=find + tail: f"len(regexp_extract_all({t}, '{p}'))"
        ctes.append(f"p{k} AS (SELECT *, {n(last)} + {n(once(last))} AS n{k}, {once(once(last))} AS t{k} FROM {'f' if k == 1 else f'p{k - 1}'})")
        last = f"t{k}"
        counts.append(f"n{k}")
    ctes.append("r AS (SELECT doc_id, source, t0, CAST(" + " + ".join(counts) + f" + CAST(contains({last}, 'Eterna1153Num. 31:50') AS INTEGER) AS INTEGER) AS markers, replace({last}, 'Eterna1153Num. 31:50', 'Eternal [153] Num. 31:50') AS t FROM p3)")
    return ", ".join(ctes)


_SIDES = """c AS (SELECT conv_id, turn // 2 AS idx, {label} AS label, role, text FROM conversations),
p AS (SELECT conv_id, idx, coalesce(label, CAST(idx + 1 AS VARCHAR)) AS label, text FROM c WHERE role = 'user'),
s AS (SELECT conv_id, idx, coalesce(label, CAST(idx + 1 AS VARCHAR)) AS label, text FROM c WHERE role = 'assistant'),
f AS (SELECT conv_id, label, min(idx) AS idx FROM s GROUP BY ALL),
a AS (SELECT p.conv_id, p.label, p.idx AS primary_index, coalesce(f.idx, s.idx) AS secondary_index, p.text AS primary_text
      FROM p LEFT JOIN f ON p.conv_id = f.conv_id AND p.label = f.label LEFT JOIN s ON f.idx IS NULL AND p.conv_id = s.conv_id AND p.idx = s.idx),
r AS (SELECT conv_id, label, primary_index, secondary_index, primary_text FROM a UNION ALL
      SELECT conv_id, label, NULL, idx, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = s.conv_id AND a.secondary_index = s.idx))"""
_LINES = "l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(replace({text}, chr(13), ''), chr(10)) AS x FROM documents))"

_EDITIONS = r"WITH w AS (SELECT 'p/' || CAST(p_partkey AS VARCHAR) AS key, trim(regexp_replace(regexp_replace(lower(p_brand || ' of the ' || p_name), '" + text.TITLE_FILLERS + r"', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS identity, p_partkey % 3 <> 0 AS readable FROM part)"
_BUDGET = "o AS (SELECT source, doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents), g AS (SELECT *, least(5000, octet_length(encode(t))) AS want FROM o WHERE ordinal <= 24 AND length(t) > 0), b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), n AS (SELECT source, doc_id, ordinal, t, CAST(least(want, 36000 - before) AS BIGINT) AS bytes FROM b WHERE before < 36000)"
_WORKS = "d AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id // 4 END AS work_index FROM documents)"

ORACLES = {
    "prompt_texts": f"WITH {_BUDGET}, k AS (SELECT *, CASE WHEN octet_length(encode(t)) <= bytes THEN length(t) ELSE list_max([k FOR k IN range(0, bytes + 1) IF octet_length(encode(left(t, k))) <= bytes]) END AS k FROM n) SELECT source, doc_id, md5(left(t, k)) AS digest, CAST(length(left(t, k)) AS INTEGER) AS length FROM k",
    "prompt_bundles": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents), e AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM r WHERE o <= 24) SELECT source, 'QUESTION:' || chr(10) || 'What is it?' || chr(10) || chr(10) || 'LOCAL CONTEXT:' || chr(10) || string_agg(chr(10) || '[' || id || ']' || CASE WHEN doc_id % 3 = 0 THEN ' (note)' ELSE '' END || ' T' || id || chr(10) || 'item ' || id || chr(10), '' ORDER BY doc_id) AS prompt, string_agg(id, ',' ORDER BY doc_id) AS ids FROM e GROUP BY source",
    "search_with_titles": f"WITH {_WORKS} SELECT doc_id, 'w/' || CAST(p_partkey AS VARCHAR) AS work_key, p_name AS work_title, p_brand AS edition_title FROM d JOIN part ON p_partkey = work_index WHERE list_has_all({_TOK}, ['the', 'and'])",
    "concordance_of_works": "WITH " + _WORKS + r", c AS (SELECT work_index, CAST(sum(len([w FOR w IN regexp_extract_all(text, '[\p{L}\p{N}''’]+') IF regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') = 'the'])) AS BIGINT) AS count FROM d GROUP BY 1) SELECT work_index, p_name AS work_title, count FROM c JOIN part ON p_partkey = work_index WHERE count > 0 ORDER BY count DESC, work_title, work_index LIMIT 100",
    "footnote_repair": f"WITH {_FUSED}, {_passes()} SELECT doc_id, markers, t <> t0 AS changed, 0 AS left_over FROM r",
    "footnote_audit": f"WITH {_FUSED}, {_passes()} SELECT source, CAST(sum(markers) AS BIGINT) AS markers, count(*) FILTER (t <> t0) AS segments_changed, count(*) AS segments FROM r GROUP BY ROLLUP (source)",
    "text_functions": r"""SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS label,
      p_name || ' &lt;&amp;&#39;&quot;&gt;' AS escaped, p_name AS name, 'a b ' || p_name AS compact, p_name || '. ' || p_brand || '. Chapter 1:' || CAST(p_size AS VARCHAR) || '. Library.' AS citation, printf('%,d', p_partkey * 12345) AS grouped,
      'vol ' || p_name AS reference, p_name || '- a-b' AS file, p_name || '.x' AS base, replace(p_name, ' ', '%20') AS path,
      lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ord(substr(p_name, i, 1)) AS BIGINT) FOR i IN range(1, length(p_name) + 1)]), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)) AS id FROM part""",
    "title_label": "WITH s AS (SELECT p_partkey, 'o''neil (x) a.b ' || replace(p_name, '-', ' ') || ' éa xÉb' AS s FROM part) SELECT p_partkey, array_to_string([CASE WHEN substr(s, i, 1) BETWEEN 'a' AND 'z' AND (i = 1 OR NOT regexp_matches(substr(s, i - 1, 1), '[A-Za-z0-9]')) THEN upper(substr(s, i, 1)) ELSE substr(s, i, 1) END FOR i IN range(1, length(s) + 1)], '') AS label FROM s",
    "alias_functions": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'genesis|b' || CAST(p_partkey % 3 AS VARCHAR) || '|gen' WHEN 1 THEN 'psalms|b' || CAST(p_partkey % 3 AS VARCHAR) || '|ps|psalm|psa' WHEN 2 THEN '1 john|b' || CAST(p_partkey % 3 AS VARCHAR) || '|1 jhn' WHEN 3 THEN '2 kings|b' || CAST(p_partkey % 3 AS VARCHAR) || '|2 kin' WHEN 4 THEN '3 unknown|b' || CAST(p_partkey % 3 AS VARCHAR) || '|3 unk' WHEN 5 THEN 'acts|b' || CAST(p_partkey % 3 AS VARCHAR) || '|act' ELSE 'jude|b' || CAST(p_partkey % 3 AS VARCHAR) || '|jud' END AS aliases, CASE p_partkey % 5 WHEN 0 THEN 'Collection IV' WHEN 1 THEN 'Documented Sources 12' WHEN 2 THEN 'Original-Language Critical Pseudepigrapha' WHEN 3 THEN 'ed-' || CAST(p_partkey AS VARCHAR) ELSE 'A · B' END AS title FROM part",
    "diff_tokens": r"SELECT conv_id, turn, md5(array_to_string(x, '|')) AS digest, CAST(len(x) AS INTEGER) AS n FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}''’]+|[^\s\p{L}\p{N}''’]+') AS x FROM conversations)",
    "source_profile": "SELECT p_partkey, 'w/' || CAST(p_partkey AS VARCHAR) AS work_key, CASE WHEN p_partkey % 2 <> 0 THEN p_name WHEN p_partkey % 4 <> 0 THEN 'book' ELSE p_type END AS title, p_brand AS edition, 'C' AS collection, CASE WHEN p_partkey % 2 <> 0 THEN 'en' ELSE '' END AS language, 'local-readable' AS content_state, CASE WHEN p_partkey % 5 <> 0 THEN 'http://w' END AS source_url, CASE WHEN p_partkey % 4 <> 0 THEN 'held' ELSE 'open' END AS rights, 'CC' AS license, 'http://l' AS license_url, CASE WHEN p_partkey % 3 <> 0 THEN 'B' ELSE 'E' END AS translator, '' AS attribution, 'n' AS source_note, 'm' AS manuscript_witnesses, CAST(0 AS INTEGER) AS source_urls FROM part",
    "search_all_terms": f"SELECT doc_id, lang, source FROM documents WHERE list_has_all({_TOK}, ['the', 'and']) ORDER BY doc_id LIMIT 200",
    "search_union_imports": f"SELECT imported, key, part FROM (SELECT false AS imported, doc_id AS key, CAST(0 AS BIGINT) AS part, text FROM documents UNION ALL SELECT true, conv_id, turn, text FROM conversations) WHERE list_has_all({_TOK}, ['the', 'of']) ORDER BY imported, key, part LIMIT 200",
    "retrieve_scored_topk": f"SELECT doc_id, CAST(score AS INTEGER) AS score FROM (SELECT doc_id, 3 * ({_FOUND}) + CASE WHEN contains(lower(text), '{QUESTION.lower()}') THEN 8 ELSE 0 END AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 18",
    "chapter_context_fallback": f"WITH s AS (SELECT conv_id, turn, role, CAST(3 * ({_FOUND}) AS INTEGER) AS score FROM conversations), m AS (SELECT *, max(score) OVER (PARTITION BY conv_id) AS best FROM s) SELECT conv_id, turn, role, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, role) AS place FROM m WHERE score > 0 OR best = 0) WHERE place <= 10",
    "grounding_priority_union": "WITH u AS (SELECT 'd' || CAST(item_id % 25 AS VARCHAR) AS id, 0 AS producer, item_id AS pos, text FROM benchmark UNION ALL SELECT 'd' || CAST(doc_id % 40 AS VARCHAR), 1, doc_id, text FROM documents UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR), 2, conv_id * 1000 + turn, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY producer, pos) AS nth FROM u WHERE length(trim(text)) > 0) SELECT id, producer, pos FROM r WHERE nth = 1 ORDER BY producer, pos LIMIT 30",
    "prompt_byte_budget": "WITH o AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents), w AS (SELECT *, least(5000, octet_length(encode(trim(text, ' ' || chr(10) || chr(9) || chr(13))))) AS want FROM o WHERE ordinal <= 24 AND length(trim(text)) > 0), b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT source, doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(least(want, 36000 - before) AS BIGINT) AS bytes FROM b WHERE before < 36000",
    "concordance_by_work": r"SELECT source, CAST(sum(n) AS BIGINT) AS count FROM (SELECT source, len([w FOR w IN regexp_extract_all(text, '[\p{L}\p{N}''’]+') IF regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') = 'the']) AS n FROM documents) WHERE n > 0 GROUP BY source ORDER BY count DESC, source",
    "concordance_hits": r"SELECT doc_id, source, CAST(n AS BIGINT) AS count FROM (SELECT doc_id, source, len([w FOR w IN regexp_extract_all(text, '[\p{L}\p{N}''’]+') IF regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') = 'the']) AS n FROM documents) WHERE n > 0",
    "concordance_total": r"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) AS hits FROM (SELECT len([w FOR w IN regexp_extract_all(text, '[\p{L}\p{N}''’]+') IF regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') = 'the']) AS n FROM documents) WHERE n > 0",
    "token_counts": rf"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS search, CAST(least(8, len(list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']{{3,}}') IF NOT list_contains({_STOP}, w)]))) AS INTEGER) AS terms, CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}''’]+')) AS INTEGER) AS words, CAST(len(list_distinct({_TOK})) AS INTEGER) AS kinds FROM documents",
    "shard_stats": "SELECT CAST(doc_id % 64 AS INTEGER) AS shard, count(DISTINCT doc_id) AS works, count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "shard_tokens": f"SELECT shard, count(*) AS tokens FROM (SELECT DISTINCT CAST(doc_id % 64 AS INTEGER) AS shard, unnest({_TOK}) AS token FROM documents) GROUP BY shard",
    "token_fnv1a": _HASH.replace("SEED", str(hashing.FNV_OFFSET)).replace("STEP", "(xor(h, c) * 16777619) & 4294967295"),
    "token_times33": _HASH.replace("SEED", str(hashing.SEED33)).replace("STEP", "xor((h * 33) & 4294967295, c)"),
    "bloom_shard_prune": f"SELECT doc_id FROM documents WHERE list_has_all({_TOK}, ['the', 'and']) ORDER BY doc_id LIMIT 200",
    "align_by_label": f"WITH {_SIDES.format(label='CASE WHEN turn % 3 <> 0 THEN CAST(turn // 2 + conv_id % 2 AS VARCHAR) END')} SELECT conv_id, label, primary_index, secondary_index FROM r",
    "variant_rows": "WITH " + _SIDES.format(label="CAST(NULL AS VARCHAR)") + r", e AS (SELECT r.*, s.text AS secondary_text FROM r LEFT JOIN s ON r.conv_id = s.conv_id AND r.secondary_index = s.idx) SELECT conv_id, label, primary_index, secondary_index FROM e WHERE lower(trim(regexp_replace(coalesce(primary_text, ''), '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(coalesce(secondary_text, ''), '\s+', ' ', 'g')))",
    "common_chapters": "SELECT conv_id, turn // 2 AS pair FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id, turn // 2 FROM conversations WHERE role = 'assistant'",
    "edition_members": _EDITIONS + " SELECT identity, key, readable, count(*) FILTER (readable) OVER (PARTITION BY identity) AS n_readable FROM w WHERE identity <> ''",
    "edition_pairs": _EDITIONS + " SELECT a.key, b.key AS other FROM w a JOIN w b ON a.identity = b.identity AND a.key <> b.key AND b.readable WHERE a.identity <> '' AND a.key = 'p/69'",
    "blank_line_blocks": "WITH " + _LINES.format(text="regexp_replace(text, '\\.\\n', '.' || chr(10) || chr(10), 'g')") + ", b AS (SELECT *, length(trim(line)) = 0 AS blank FROM l), s AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS start FROM b), n AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s) SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS n_lines, CAST(length(string_agg(trim(line), ' ' ORDER BY line_no)) AS INTEGER) AS length FROM n WHERE NOT blank GROUP BY doc_id, block",
    "heading_sections": "WITH " + _LINES.format(text="text") + r", h AS (SELECT *, regexp_matches(line, '^\S+( \S+){0,3}$') AS head FROM l), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h) SELECT doc_id, CAST(section AS BIGINT) AS section, min_by(line, line_no) AS title, CAST(min(line_no) AS INTEGER) AS first_line, count(*) - 1 AS n_lines FROM s WHERE section > 0 GROUP BY doc_id, section",
    "carried_sections": "WITH " + _LINES.format(text="text") + r", h AS (SELECT *, regexp_matches(line, '^\S+$') AS p, regexp_matches(line, '^\S+( \S+){1,4}$') AS c FROM l), s AS (SELECT *, last_value(CASE WHEN p THEN line END IGNORE NULLS) OVER w AS part, sum(CAST(c AS INTEGER)) OVER w AS chapter_no FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc_id, CAST(chapter_no AS BIGINT) AS chapter_no, arg_min_null(part, line_no) AS part, min_by(line, line_no) AS title, count(*) FILTER (NOT p AND NOT c AND length(trim(line)) > 0) AS n_lines FROM s WHERE chapter_no > 0 GROUP BY doc_id, chapter_no",
    "txt_import": r"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n', chr(10) || chr(10), 'g'), '\n\n(\S+ \S+)\n\n', chr(10) || chr(10) || 'Chapter \1' || chr(10) || chr(10), 'g') AS t FROM documents), p AS (SELECT doc_id, [trim(x, ' ' || chr(10)) FOR x IN string_split_regex(t, '\n\s*\n+') IF length(trim(x, ' ' || chr(10))) > 0] AS x FROM t), u AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS par FROM p), h AS (SELECT *, regexp_matches(par, '(?i)^(chapter|section)\s+.+$') AS head FROM u), o AS (SELECT *, head AND NOT coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY pos), true) AS opens FROM h), c AS (SELECT *, 1 + sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM o), n AS (SELECT doc_id, chapter, max_by(par, pos) AS name FROM c WHERE head GROUP BY ALL) SELECT c.doc_id, CAST(c.chapter AS BIGINT) AS chapter, coalesce(n.name, 'Chapter ' || CAST(CAST(c.chapter AS BIGINT) AS VARCHAR)) AS chapter_label, CAST(row_number() OVER (PARTITION BY c.doc_id, c.chapter ORDER BY pos) AS INTEGER) AS passage, CAST(length(par) AS INTEGER) AS length FROM c LEFT JOIN n ON c.doc_id = n.doc_id AND c.chapter = n.chapter WHERE NOT head",
    "consecutive_groups": "WITH c AS (SELECT doc_id, lang, doc_id // 100 AS h, lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) OR lag(doc_id) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) IS NULL AS new FROM documents) SELECT doc_id, lang, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY h ORDER BY doc_id) AS BIGINT) AS group_no FROM c",
    "payload_digest": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents",
    "html_assignment_scan": "SELECT page_id, page_id AS inner_id, url AS inner_url FROM pages",
    "packed_payloads": "SELECT doc_id, md5(text) AS digest FROM documents",
    "export_txt": "WITH l AS (SELECT conv_id, turn, CAST(turn AS VARCHAR) || ' ' || role || ' ' || text AS line FROM conversations), b AS (SELECT conv_id, 'Conversation' || chr(10) || chr(10) || 'Chapter 1' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) || chr(10) AS content FROM l GROUP BY conv_id) SELECT conv_id, md5(content) AS digest, CAST(octet_length(encode(content)) AS INTEGER) AS bytes FROM b",
    "research_bundle": "SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS notes, CAST(count(*) FILTER (role <> 'user') AS INTEGER) AS items FROM conversations GROUP BY conv_id",
    "manifest": "SELECT doc_id, CAST(octet_length(encode(text || chr(10))) AS INTEGER) AS bytes, sha256(text || chr(10)) AS sha256 FROM documents ORDER BY doc_id",
    "corpus_totals": "SELECT count(*) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len([x FOR x IN string_split(text, chr(10)) IF length(trim(x)) > 0])) AS BIGINT) AS segments FROM documents",
    "lexicon_key": "WITH q AS (SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey < 100000 AND length(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE ltrim(CAST(p_partkey AS VARCHAR), '0') END) <= 5 AS ok, CASE WHEN p_partkey % 2 = 0 THEN 'G' ELSE 'H' END AS l FROM part) SELECT p_partkey, CASE WHEN ok THEN l END AS letter, CASE WHEN ok THEN l || CAST(p_partkey AS VARCHAR) END AS plain, CASE WHEN ok THEN l || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END END AS padded FROM q",
    "dictionary_lookup": "WITH w AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY 1), e AS (SELECT * FROM w WHERE lower(name) = 'red widget' ORDER BY pos LIMIT 1) SELECT *, 'Red Widget' AS asked FROM e UNION ALL (SELECT *, 's' FROM w WHERE starts_with(lower(name), 's') ORDER BY pos LIMIT 20)",
}
