"""Book payloads (nested JSON, one file a work, plain or gzip) as one long table of segments, and exports of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, udfs

SEGMENT = "struct<v:string,label:string,text:string,kind:string,sourceRef:string,manuscript:string,fragmentOrColumn:string,sourceLine:string,editorialNote:string>"
PAYLOAD = f"edition struct<id:string,title:string,language:string,rights:string,license:string>, book struct<id:string,name:string,title:string,chapters:int,verses:int,rights:string,license:string>, chapters map<string,array<{SEGMENT}>>, chapterLabels map<string,string>, contentMode string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files under a folder, plain or with .gz after .json. The schema is given, for inference would make every chapter a column."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json{,.gz}").json(path)


def read_zipped(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, member, content) of the files in zip archives under a folder, in the archives' order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.explode(udfs.unzipped("content")).alias("m")).select("path", "m.member", "m.content")


def read_maybe_gzip(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of files as text, unpacked where they start as a gzip stream whatever their name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode(udfs.gunzip("content"), "UTF-8").alias("content"))


def segments_of(payloads: DataFrame) -> DataFrame:
    """work_key, chapter, chapter_ord, seg_idx, label, text, kind. Chapters with whole numbers as keys come first in their order, then the others as written."""
    rows = payloads.select(F.concat_ws("/", "edition.id", "book.id").alias("work_key"), F.posexplode("chapters").alias("pos", "chapter", "segments"))
    whole = F.when(F.col("chapter").rlike(r"^(0|[1-9]\d{0,8})\z"), F.col("chapter").cast("long"))
    order = F.struct(whole.isNull().alias("other"), whole.alias("number"), F.col("pos").alias("pos"))
    out = rows.select("work_key", "chapter", order.alias("chapter_ord"), F.posexplode("segments").alias("seg_idx", "s"))
    label = F.coalesce("s.label", "s.v", (F.col("seg_idx") + 1).cast("string"))
    return out.select("work_key", "chapter", "chapter_ord", "seg_idx", label.alias("label"), F.col("s.text").alias("text"), F.col("s.kind").alias("kind"))


def normalised_segments(column: str):
    """An import's segments as structs (label, text), from VARIANT.

    A string is a segment as it is, blank or not, labelled by its place. An object has text or else value, trimmed, and
    label, else v, else its place as label; blank ones and all other kinds are left out.
    """
    items = F.try_variant_get(column, "$", "array<variant>")
    get = lambda v, *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))
    plain = lambda v: F.schema_of_variant(v) == "STRING"
    place = lambda k: (k + 1).cast("string")
    rows = F.transform(items, lambda v, k: F.when(plain(v), F.struct(place(k).alias("label"), F.try_variant_get(v, "$", "string").alias("text"), F.lit(True).alias("plain")))
        .otherwise(F.struct(F.coalesce(get(v, "label", "v"), place(k)).alias("label"), text.trimmed(get(v, "text", "value")).alias("text"), F.lit(False).alias("plain"))))
    return F.filter(rows, lambda s: s["plain"] | (F.coalesce(s["text"], F.lit("")) != ""))


def json_import(files: DataFrame, key: str, column: str = "content", name: str | None = None) -> DataFrame:
    """(key, title, chapter, chapter_label, label, text) of imported JSON; name is a column with the file's name ("import.json" where none is given).

    Where a book and chapters are both given, the book's title counts, then its name; else the top's title, then its
    name. Where these are empty the file's name without its ending does. A title is trimmed, and a blank one is
    "Imported book". Labels of chapters are the top's, else the book's. As an extension, chapters may lie under the book.
    """
    file = text.filled(F.col(name) if name else F.lit(None).cast("string"), F.lit("import.json"))
    parsed = files.select(key, F.regexp_replace(file, r"(?i)\.json\z", "").alias("file"), F.try_parse_json(column).alias("j"))
    get = lambda path, kind="string": F.try_variant_get("j", path, kind)
    at_top, under = get("$.chapters", "map<string,variant>"), get("$.book.chapters", "map<string,variant>")
    of_book, of_top = text.filled(get("$.book.title"), get("$.book.name")), text.filled(get("$.title"), get("$.name"))
    nested = get("$.book", "variant").isNotNull() & at_top.isNotNull()
    title = text.trimmed(text.filled(F.when(nested, of_book).when(at_top.isNotNull(), of_top).otherwise(F.coalesce(of_book, of_top)), "file"))
    labels = F.coalesce(get("$.chapterLabels", "map<string,string>"), get("$.book.chapterLabels", "map<string,string>"))
    rows = parsed.select(key, text.filled(title, F.lit("Imported book")).alias("title"), labels.alias("labels"), F.explode(F.coalesce(at_top, under)).alias("chapter", "v"))
    rows = rows.withColumn("s", F.explode(normalised_segments("v")))
    return rows.select(key, "title", "chapter", F.try_element_at("labels", F.col("chapter")).alias("chapter_label"), "s.label", "s.text")


def export_txt(segments: DataFrame, key: str, chapter: str, order: list[str], header: str) -> DataFrame:
    """(key, content): the header, then each chapter's heading and its "label text" lines."""
    line = F.concat_ws(" ", "label", F.col("text"))
    chapters = segments.groupBy(key, chapter).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n").alias("_body"))
    whole = chapters.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(chapter, "_body"))).alias("_c"))
    parts = F.transform("_c", lambda c: F.concat(F.lit("Chapter "), c[chapter].cast("string"), F.lit("\n"), c["_body"]))
    return whole.select(key, F.concat(F.lit(header), F.lit("\n\n"), F.array_join(parts, "\n\n"), F.lit("\n")).alias("content"))


def research_bundle(items: DataFrame, group: str, title: str, schema: str, time: str | None = None) -> DataFrame:
    """(group, bundle): a JSON envelope of the items (kind: items, notes, citations or sources; pos; body)."""
    when = F.lit(time) if time else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    part = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "body")))), lambda x: x["body"]).alias(kind)
    rows = items.groupBy(group).agg(*(part(k) for k in ("items", "notes", "citations", "sources")))
    return rows.select(group, F.to_json(F.struct(F.lit(schema).alias("schema"), when.alias("exportedAt"), F.lit(title).alias("title"), "items", "notes", "citations", "sources")).alias("bundle"))


def manifest(payload_texts: DataFrame, key: str, column: str = "content") -> DataFrame:
    """(key, bytes, sha256) of compact payloads that end with a newline, in key order."""
    body = F.concat(column, F.lit("\n"))
    return payload_texts.select(key, F.octet_length(body).alias("bytes"), hashing.sha256(body).alias("sha256")).orderBy(key)


def assets(rows: DataFrame, name: str = "name", url: str = "url") -> DataFrame:
    """(name, path, mime_type, bytes, sha256, content) of images kept as data URLs: the path has the kind's ending in place of the name's own. What is no image's data URL is an error."""
    got = rows.select(F.col(name).alias("name"), text.data_url_bytes(F.col(url)).alias("_d"), F.col(url).alias("_url"))
    bad = F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("name", F.lit("null"))))
    kind = F.when(F.col("_d").isNotNull(), F.col("_d.kind")).otherwise(bad)
    path = F.concat(F.lit("assets/"), F.regexp_replace("name", r"\.[^.]+\z", F.concat(F.lit("."), F.regexp_replace(kind, "^image/", ""))))
    return got.select("name", path.alias("path"), kind.alias("mime_type"), F.octet_length("_d.bytes").alias("bytes"), F.sha2("_d.bytes", 256).alias("sha256"), F.col("_d.bytes").alias("content"))


def embedded(pages: DataFrame, key: str, name: str, column: str = "html") -> DataFrame:
    """(key, value, problem): what a page's script assigns to window.<name>, as VARIANT, or why there is none."""
    rows = pages.select(key, udfs.window_assignment(F.col(column), F.lit(name)).alias("_got")).select(key, F.try_parse_json("_got.json").alias("value"), F.col("_got.problem").alias("problem"))
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("value").isNull(), F.lit(f"the value assigned to {name} isn't JSON"))))


def embedded_or_fail(pages: DataFrame, key: str, name: str, column: str = "html") -> DataFrame:
    """embedded() where a page without a value is an error."""
    rows = embedded(pages, key, name, column)
    return rows.select(key, F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(F.col("problem"))).alias("value"))


def packed(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """(key, content) of base64 gzip payloads."""
    return payloads.select(key, F.decode(udfs.gunzip(F.unbase64(column)), "UTF-8").alias("content"))
