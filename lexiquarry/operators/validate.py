"""Corpus invariants: each rule gives its violations as rows (rule, subject, detail); none fails fast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .catalog import STATES

SHOWN = 100
#: Estimated bytes of a key column for a part of dealt(), at most; with compressed files that is some hundred thousand rows.
PART_BYTES = 1 << 20


def parts(rows: DataFrame, key: str) -> int:
    """Parts for dealt(): as many as a shuffle has, and more as the frame grows."""
    spark = rows.sparkSession
    size = int(str(rows.select(key)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if size < 1 << 60 else 0))


def dealt(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The frame by hash of a key over parts whose number follows its size and which aren't merged to 64 compressed MB, so that a task's sorts and groups stay small; rules by that key need no other shuffle."""
    return rows.repartition(n or parts(rows, key), key)


def counts(segments: DataFrame, key: str = "work_key") -> DataFrame:
    """(name, n): segments by work."""
    return dealt(segments.select(F.col(key).alias("name")), "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, rule: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violations(found, rule, F.concat_ws("|", *keys), F.col("n"))


def orphans(rows: DataFrame, parents: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Rows whose key no parent has."""
    found = rows.filter(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return violations(found, rule, F.col(child_key))


def wrong_digests(files: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Manifest entries without a file, and files of another digest."""
    both = manifest.select(key, F.col("sha256").alias("want")).join(files.select(key, F.col("sha256").alias("got")), key, "left")
    return violations(both.filter(~F.col("want").eqNullSafe(F.col("got"))), "digest", F.col(key), F.coalesce("got", F.lit("missing")))


def work_rules(works: DataFrame, local: DataFrame) -> list[DataFrame]:
    """Rules of the work index: works(key, content_state, reader_path, source_url), local(key)."""
    readable = F.col("content_state") == "local-readable"
    held = works.join(local.select("key").distinct().withColumn("held", F.lit(True)), "key", "left")
    return [
        duplicates(works, ["key"], "unique-key"),
        violations(works.filter(~F.coalesce(F.col("content_state").isin(*STATES), F.lit(False))), "state-domain", F.col("key"), F.coalesce("content_state", F.lit("null"))),
        violations(held.filter(readable & (F.col("held").isNull() | F.col("reader_path").isNull())), "readable-has-payload", F.col("key")),
        violations(held.filter(~readable & (F.col("held").isNotNull() | F.col("reader_path").isNotNull())), "others-have-none", F.col("key")),
        violations(works.filter((F.col("content_state") == "source-readable") & ~F.coalesce(F.col("source_url").rlike("(?i)^https?://"), F.lit(False))), "source-url", F.col("key"), F.col("source_url")),
    ]


def payload_rules(segments: DataFrame) -> list[DataFrame]:
    """Rules of segments(work_key, chapter, seg_idx, text)."""
    return [violations(segments.filter(text.is_blank(F.col("text"))), "blank-text", F.concat_ws("|", "work_key", "chapter", "seg_idx"))]


def content_rules(files: DataFrame, local: DataFrame) -> list[DataFrame]:
    """Rules of files(key, content), the payloads as JSON texts, and local(key): each readable work has one, it is JSON, has sections, they are arrays, and no segment is blank."""
    parsed = files.withColumn("j", F.try_parse_json("content"))
    chapters = F.try_variant_get("j", "$.chapters", "map<string,variant>")
    sections = parsed.filter("j IS NOT NULL").select("key", F.explode_outer(chapters).alias("chapter", "v"))
    is_array = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    items = sections.filter(F.col("chapter").isNotNull() & is_array).select("key", "chapter", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("k", "s"))
    said = F.when(F.schema_of_variant(F.try_variant_get("s", "$.text", "variant")) == "STRING", F.try_variant_get("s", "$.text", "string"))
    return [
        orphans(local, files, "key", "key", "work-has-payload"),
        violations(parsed.filter("j IS NULL"), "payload-is-json", F.col("key")),
        violations(sections.filter("chapter IS NULL"), "payload-has-sections", F.col("key")),
        violations(sections.filter(F.col("chapter").isNotNull() & ~is_array), "section-is-array", F.concat_ws("|", "key", "chapter")),
        violations(items.filter(text.is_blank(said)), "segment-has-text", F.concat_ws("|", "key", "chapter", (F.col("k") + 1).cast("string"))),
    ]


def manifest_rules(manifest: DataFrame, actual: DataFrame, rule: str = "manifest-count") -> list[DataFrame]:
    """Counts (name, n) that a manifest or a search index declares against those that are there; a name that only one side has is a violation too."""
    both = manifest.select("name", F.col("n").alias("said")).join(actual.select("name", F.col("n").alias("found")), "name", "full_outer")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return [violations(both.filter(~F.col("said").eqNullSafe(F.col("found"))), rule, F.col("name"), F.concat(F.lit("said "), shown("said"), F.lit(", found "), shown("found")))]


def mapping_rules(mapping: DataFrame, local: DataFrame) -> list[DataFrame]:
    return [orphans(mapping, local, "work_key", "key", "mapping-has-work"), orphans(local, mapping, "key", "work_key", "work-has-mapping")]


def count_rules(spark: SparkSession, actual: dict[str, DataFrame], expected: dict[str, int]) -> list[DataFrame]:
    """Expected row counts; they are parameters, for each corpus has its own."""
    return [violations(frame.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected[name]), "count", F.lit(name), F.col("n")) for name, frame in actual.items() if name in expected]


def report(rules: list[DataFrame]) -> DataFrame:
    """All violations."""
    return reduce(DataFrame.unionByName, rules)


def verdict(found: DataFrame) -> DataFrame:
    """PASS or FAIL with the number of errors."""
    return found.agg(F.count(F.lit(1)).alias("errors")).withColumn("result", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))


def shown(found: DataFrame) -> DataFrame:
    """The first SHOWN violations, in order."""
    return found.orderBy("rule", "subject", "detail").limit(SHOWN)


def validated(works: DataFrame, files: DataFrame, segments: DataFrame, mapping: DataFrame, expected: dict[str, int], manifest: DataFrame | None = None) -> DataFrame:
    """One run over all rules: violations of works, payloads (files: key, content), segments, mapping(work_key), expected numbers of rows by name, and of a manifest(name, n) of segments by work."""
    n = parts(works, "key")
    works, files, mapping = dealt(works, "key", n), dealt(files, "key", n), dealt(mapping, "work_key", n)
    local = works.filter(F.col("content_state") == "local-readable").select("key")
    rules = [*work_rules(works, files.select("key")), *content_rules(files, local), *payload_rules(segments), *mapping_rules(mapping, local)]
    rules += count_rules(works.sparkSession, {"works": works, "readable": local, "segments": segments, "mapping": mapping}, expected)
    if manifest is not None:
        rules += manifest_rules(manifest, counts(segments))
    return report(rules)
