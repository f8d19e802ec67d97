"""Study material beside a work: mapping, resources of five kinds, context rows, profiles, lexicon rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CONTEXT_LIMIT, CONTEXT_SCORE = 12, 12
HIDDEN_FIELDS = ("sourceUrl",)


def resolved(works: DataFrame, mapping: DataFrame, resources: DataFrame) -> DataFrame:
    """works(key) with kind, study_id and the resource that the mapping names, null where there is none. resources: kind, study_id, title, ..."""
    named = works.join(mapping.withColumnRenamed("work_key", "key"), "key", "left")
    return named.join(resources, ["kind", "study_id"], "left")


def unresolved(mapping: DataFrame, resources: DataFrame) -> DataFrame:
    """Mappings that no resource of their kind answers."""
    return mapping.join(resources.select("kind", "study_id"), ["kind", "study_id"], "left_anti")


def commentary_rows(commentary: DataFrame) -> DataFrame:
    """Context rows of commentary(study_id, chapter, pos, verses, text)."""
    return commentary.select("study_id", "chapter", F.lit(0).alias("part"), "pos", F.concat(F.lit("study:bible:"), "study_id", F.lit("|"), "chapter", F.lit("|commentary-"), F.col("pos") + 1).alias("id"), text.filled(F.col("verses"), F.lit("Commentary")).alias("passage"), "text")


def reference_rows(crossrefs: DataFrame) -> DataFrame:
    """Context rows of crossrefs(study_id, chapter, pos, verse, anchor, references)."""
    body = F.concat(text.filled(F.col("anchor"), F.lit("Reference")), F.lit(": "), F.array_join(F.coalesce("references", F.array().cast("array<string>")), ", "))
    return crossrefs.select("study_id", "chapter", F.lit(1).alias("part"), "pos", F.concat(F.lit("study:bible:"), "study_id", F.lit("|"), "chapter", F.lit("|crossref-"), F.col("pos") + 1).alias("id"), F.coalesce("verse", F.lit("")).alias("passage"), body.alias("text"))


def note_rows(notes: DataFrame) -> DataFrame:
    """Context rows of notes(kind, study_id, chapter, pos, note) whose note is VARIANT: a text, or an object with text, passage and type."""
    get = lambda path: F.try_variant_get("note", path, "string")
    body = F.coalesce(get("$.text"), F.when(F.schema_of_variant("note") == "STRING", get("$")))
    return notes.select("study_id", "chapter", F.lit(0).alias("part"), "pos", F.concat(F.lit("study:"), "kind", F.lit(":"), "study_id", F.lit("|"), "chapter", F.lit("|"), F.col("pos") + 1).alias("id"), F.coalesce(text.filled(get("$.passage"), get("$.type")), F.lit("")).alias("passage"), body.alias("text"))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Context rows of profiles(kind, study_id, fields): a map's filled fields in its order, but for the hidden ones."""
    rows = profiles.select("kind", "study_id", F.posexplode("fields").alias("pos", "name", "value")).filter(~F.col("name").isin(*HIDDEN_FIELDS))
    return rows.select("study_id", F.lit("").alias("chapter"), F.lit(0).alias("part"), "pos", F.concat(F.lit("study:"), "kind", F.lit(":"), "study_id", F.lit("|profile|"), "name").alias("id"), F.col("name").alias("passage"), F.col("value").alias("text"))


def context(rows: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The first rows of every record and chapter, blank ones left out, all with the same score."""
    clean = rows.withColumn("text", text.trimmed(F.col("text"))).filter(F.coalesce(F.col("text"), F.lit("")) != "")
    place = F.row_number().over(Window.partitionBy("study_id", "chapter").orderBy("part", "pos", "text", "passage"))
    return clean.withColumn("place", place).filter(F.col("place") <= limit).withColumn("score", F.lit(CONTEXT_SCORE))


def shown_fields(fields: str, hidden: tuple[str, ...] = HIDDEN_FIELDS):
    """A profile's map without null, empty and hidden fields."""
    return F.map_filter(fields, lambda k, v: ~F.coalesce(v, F.lit("")).isin("", "[]") & ~k.isin(*hidden))


def lexicon_rows(lexicons: DataFrame, query: str) -> DataFrame:
    """Records of lexicons(source, key, record) for a number: by the plain key in one source of its letter, by the padded key in the other."""
    key = lexicons.sparkSession.range(1).select(text.strong_keys(F.lit(query)).alias("k")).first()["k"]
    if key is None:
        return lexicons.limit(0)
    language = "Hebrew" if key["letter"] == "H" else "Greek"
    plain = (F.col("source") == "strongs" + language) & (F.col("key") == key["plain"])
    return lexicons.filter(plain | ((F.col("source") == "step" + language) & (F.col("key") == key["padded"]))).filter("record IS NOT NULL").orderBy(F.desc("source"))
