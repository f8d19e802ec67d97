"""Catalog browsing: categories, groups, editions, shelves and default places of works.

works: key, work_index, edition_id, edition_title, collection_label, title, name, section, content_state.
groups: category_id, group_id, group_ord, edition_id (a row for each edition of a group).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

# Fixed values.
CATEGORIES = ("hebrew-bible", "new-testament", "apocrypha", "pseudepigrapha", "early-christian", "gnostic", "hymns", "ethiopian", "restoration", "jewish", "sources")
OT_NAMES = (
    "genesis", "exodus", "leviticus", "numbers", "deuteronomy", "joshua", "judges", "ruth", "1 samuel", "2 samuel", "1 kings", "2 kings", "1 chronicles",
    "2 chronicles", "ezra", "nehemiah", "esther", "job", "psalms", "proverbs", "ecclesiastes", "song of solomon", "isaiah", "jeremiah", "lamentations",
    "ezekiel", "daniel", "hosea", "joel", "amos", "obadiah", "jonah", "micah", "nahum", "habakkuk", "zephaniah", "haggai", "zechariah", "malachi",
)
NT_NAMES = (
    "matthew", "mark", "luke", "john", "acts", "romans", "1 corinthians", "2 corinthians", "galatians", "ephesians", "philippians", "colossians",
    "1 thessalonians", "2 thessalonians", "1 timothy", "2 timothy", "titus", "philemon", "hebrews", "james", "1 peter", "2 peter", "1 john", "2 john",
    "3 john", "jude", "revelation",
)
BIBLE_EDITIONS = ("kjv", "web", "asv", "dra", "brenton", "ylt", "gnv1599", "jps1917", "rv1885", "dby", "tyndale-nt")
TORAH_EDITIONS = ("jewish-scripture-torah", "torah-jps1917")
ENOCHIC_EDITIONS = ("enoch-charles", "enoch-odeberg-1928", "pseudepigrapha-enochic-giants")
PSEUDEPIGRAPHA_EDITIONS = ("jubilees-charles", "daniel-apocrypha-open-i")
GNOSTIC_WORDS = "gospel of thomas|gospel of mary|gospel of philip|gospel of judas|apocryphon|secret book|apocalypse of adam|apocalypse of james|hypostasis|archons|melchizedek|origin of the world|great seth|three steles|thunder|tripartite tractate"
GNOSTIC_EDITION, ETHIOPIAN_WORDS, HYMN_WORDS = "user-early-christian-gnostic-texts", "tewahedo|ethiop", "hymn|song|sacred poetry"
ACQUISITION_TITLES = (r"(?i)\bSource Pack\b", "(?i)Online Critical Pseudepigrapha", "(?i)Recovered Local Editions", "(?i)Source-Readable Works", "(?i)Bibliographic and Fragmentary Witnesses")
ACQUISITION_EDITION = "christian-apocrypha-open-i"
EXTRA_EDITIONS = {"utah-lds": ("pgp1851",), "torah": ("torah-jps1917",), "mishnah": ("rabbinic-mishnah-kulp",), "tosefta": ("rabbinic-tosefta-sefaria",), "yerushalmi": ("rabbinic-yerushalmi-guggenheimer",), "bavli": ("rabbinic-bavli-davidson",)}
READABLE = "local-readable"


def _in(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _starts(column: str, prefix: str) -> Column:
    return F.coalesce(F.col(column).startswith(prefix), F.lit(False))


def _is(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def part_of() -> Column:
    """ot, nt or other, by the work's normalised name."""
    name = text.name_norm(text.filled(F.col("name"), F.col("title")))
    return F.when(name.isin(*OT_NAMES), "ot").when(name.isin(*NT_NAMES), "nt").otherwise("other")


def described() -> Column:
    """All naming fields in one lower-case text."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("edition_id", "edition_title", "collection_label", "title", "name"))))


def families() -> dict[str, Column]:
    bible, words = _in("edition_id", BIBLE_EDITIONS), described()
    dedicated = _starts("edition_id", "gnostic-") | _is("edition_id", GNOSTIC_EDITION)
    gnostic = dedicated | (_is("edition_id", "early-christian-sacred-i") & words.contains("pistis sophia")) | (_is("edition_id", ACQUISITION_EDITION) & words.rlike(GNOSTIC_WORDS))
    enochic_edition = _in("edition_id", ENOCHIC_EDITIONS)
    return {
        "bible": bible,
        "christian_apocrypha": _is("section", "Christian Apocrypha") | _starts("edition_id", "christian-apocrypha-"),
        "pseudepigrapha": _is("section", "Pseudepigrapha") | _starts("edition_id", "pseudepigrapha-") | enochic_edition | _in("edition_id", PSEUDEPIGRAPHA_EDITIONS),
        "early_christian": _starts("edition_id", "early-christian-"),
        "gnostic": gnostic,
        "hymns": _is("section", "Hymns & Songs"),
        "ethiopian": words.rlike(ETHIOPIAN_WORDS),
        "enochic": enochic_edition | words.rlike(r"\benoch\b|book of giants"),
    }


def group_table(spark: SparkSession, taxonomy: list[tuple[str, str, list[str]]]) -> DataFrame:
    """The bridge of groups and editions from (category_id, group_id, edition ids), with the fixed additions."""
    rows = [(c, g, k, e) for k, (c, g, ids) in enumerate(taxonomy) for e in [*ids, *EXTRA_EDITIONS.get(g, ())]]
    return spark.createDataFrame(rows, "category_id string, group_id string, group_ord int, edition_id string")


def _with_groups(works: DataFrame, groups: DataFrame) -> DataFrame:
    """works with the first restoration and the first jewish group of their edition. The bridge is a taxonomy of a few rows for each edition; whether it is broadcast is left to its measured size."""
    first = lambda c: groups.filter(F.col("category_id") == c).groupBy("edition_id").agg(F.min_by("group_id", "group_ord").alias(c + "_group"))
    return works.join(first("restoration"), "edition_id", "left").join(first("jewish"), "edition_id", "left")


def category_columns(works: DataFrame, groups: DataFrame) -> DataFrame:
    """works with in_<category> flags; a work can be in several categories."""
    f, part = families(), F.col("part")
    rows = _with_groups(works, groups).withColumn("part", part_of())
    flags = {
        "hebrew-bible": (f["bible"] | _in("edition_id", TORAH_EDITIONS)) & (part == "ot"),
        "new-testament": f["bible"] & (part == "nt"),
        "apocrypha": (f["bible"] & (part == "other")) | f["christian_apocrypha"],
        "pseudepigrapha": f["pseudepigrapha"],
        "early-christian": f["early_christian"],
        "gnostic": f["gnostic"],
        "hymns": f["hymns"] | described().rlike(HYMN_WORDS),
        "ethiopian": f["ethiopian"],
        "restoration": F.col("restoration_group").isNotNull(),
        "jewish": F.col("jewish_group").isNotNull(),
        "sources": ~_is("content_state", READABLE) | _starts("edition_id", "research-"),
    }
    return rows.withColumns({"in_" + c: v for c, v in flags.items()})


def categories_of(works: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each work and category."""
    flagged = category_columns(works, groups)
    found = F.array_compact(F.array(*(F.when(F.col(f"`in_{c}`"), F.lit(c)) for c in CATEGORIES)))
    return flagged.select(*works.columns, "part", F.explode(found).alias("category_id"))


def records(works: DataFrame, groups: DataFrame, category: str, group: str = "", edition: str = "") -> DataFrame:
    """Works of a category, or of one of its groups, or of one edition there."""
    rows, f = category_columns(works, groups).filter(F.col(f"`in_{category}`")), families()
    if group and category == "apocrypha":
        test = {"biblical-apocrypha": f["bible"] & (F.col("part") == "other"), "christian-apocrypha": f["christian_apocrypha"]}
        rows = rows.filter(test.get(group, F.lit(False)))
    elif group and category == "pseudepigrapha":
        rows = rows.filter({"enochic": f["enochic"], "other-pseudepigrapha": ~f["enochic"]}.get(group, F.lit(False)))
    elif group:
        own = groups.filter((F.col("category_id") == category) & (F.col("group_id") == group)).select("edition_id")
        rows = rows.join(own, "edition_id", "left_semi")
        if category == "restoration":
            rows = rows.filter(~_is("edition_id", "kjv") | (F.col("part") != "other"))
    if edition:
        rows = rows.filter(F.col("edition_id") == edition)
    return rows.select(*works.columns)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records and readable records."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(_is("content_state", READABLE)).alias("readable"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first come."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen")).orderBy("first_seen", value)


def is_acquisition(edition_id: str = "edition_id", title: str = "edition_title") -> Column:
    """Editions that are packs of an acquisition, which browsing shows as single works."""
    named = reduce(or_, (F.coalesce(F.col(title).rlike(p), F.lit(False)) for p in ACQUISITION_TITLES))
    return named | _is(edition_id, ACQUISITION_EDITION)


def shelves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(editions that are shown as such, works of acquisition packs) of a category's or group's works."""
    packed = is_acquisition()
    return rows.filter(~packed).select("edition_id").distinct(), rows.filter(packed)


def default_place(works: DataFrame, groups: DataFrame) -> DataFrame:
    """works with category and group: one place each, by precedence."""
    f, part = families(), F.col("part")
    rows = _with_groups(works, groups).withColumn("part", part_of())
    free = ~f["bible"]
    empty = F.lit("")
    rules = [
        (F.col("restoration_group").isNotNull() & free, "restoration", F.col("restoration_group")),
        (F.col("jewish_group").isNotNull() & free, "jewish", F.col("jewish_group")),
        (f["christian_apocrypha"], "apocrypha", F.lit("christian-apocrypha")),
        (f["pseudepigrapha"], "pseudepigrapha", F.when(f["enochic"], "enochic").otherwise("other-pseudepigrapha")),
        (f["gnostic"], "gnostic", empty),
        (f["hymns"], "hymns", empty),
        (f["early_christian"], "early-christian", empty),
        (f["ethiopian"], "ethiopian", empty),
        (f["bible"] & (part == "nt"), "new-testament", empty),
        (f["bible"] & (part == "other"), "apocrypha", F.lit("biblical-apocrypha")),
        (f["bible"], "hebrew-bible", empty),
        (~_is("content_state", READABLE), "sources", empty),
    ]
    category = group = F
    for test, c, g in rules:
        category, group = category.when(test, F.lit(c)), group.when(test, g)
    return rows.select(*works.columns, category.otherwise("hebrew-bible").alias("category"), group.otherwise("").alias("group"))


def route_context(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, category, group) that a link to a work leads to: asked has works' columns and asked_category, asked_group, imported.

    An asked category that is known and holds the work stays, and with it an asked group that holds the work; else the
    work's default place. A missing group is that of the work's edition, if it holds the work. Imports have neither.
    """
    f, category, group = families(), F.col("category"), F.col("group")

    def holds(name: Column, bridged: Column) -> Column:
        split = {"biblical-apocrypha": f["bible"] & (F.col("part") == "other"), "christian-apocrypha": f["christian_apocrypha"]}
        apocrypha = reduce(or_, ((name == g) & test for g, test in split.items()))
        pseudepigrapha = ((name == "enochic") & f["enochic"]) | ((name == "other-pseudepigrapha") & ~f["enochic"])
        other = bridged & ~((category == "restoration") & _is("edition_id", "kjv") & (F.col("part") == "other"))
        return F.when(category == "apocrypha", apocrypha).when(category == "pseudepigrapha", pseudepigrapha).otherwise(other)

    rows = category_columns(asked, groups)
    known = reduce(or_, ((F.col("asked_category") == c) & F.col(f"`in_{c}`") for c in CATEGORIES))
    place = default_place(asked, groups).select("key", F.struct("category", "group").alias("default"))
    rows = rows.join(place, "key").withColumn("known", F.coalesce(known, F.lit(False)))
    rows = rows.withColumns({"category": F.when(F.col("known"), F.col("asked_category")).otherwise(F.col("default.category")), "wanted": F.when(F.col("known"), F.coalesce("asked_group", F.lit(""))).otherwise(F.col("default.group"))})
    bridge = groups.select(F.col("category_id").alias("category"), F.col("group_id").alias("wanted"), "edition_id", F.lit(True).alias("bridged")).distinct()
    first = groups.groupBy(F.col("category_id").alias("category"), "edition_id").agg(F.min_by("group_id", "group_ord").alias("inferred"))
    rows = rows.join(bridge, ["category", "wanted", "edition_id"], "left").join(first, ["category", "edition_id"], "left")
    stays = (F.col("wanted") != "") & (~F.col("known") | F.coalesce(holds(F.col("wanted"), F.coalesce("bridged", F.lit(False))), F.lit(False)))
    inferred = F.coalesce(holds(F.col("inferred"), F.lit(True)), F.lit(False))
    rows = rows.withColumn("group", F.when(stays, F.col("wanted")).when(F.col("inferred").isNotNull() & inferred, F.col("inferred")).otherwise(""))
    own = ~F.coalesce(F.col("imported"), F.lit(False))
    return rows.select("key", F.when(own, category).otherwise("").alias("category"), F.when(own, group).otherwise("").alias("group"))


def home_counts(works: DataFrame, segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of what a library holds: readable works, all records, sections, study mappings."""
    w = works.agg(F.count_if(_is("content_state", READABLE)).alias("readable"), F.count(F.lit(1)).alias("records"))
    s = segments.agg(F.count_distinct("work_key", "chapter").alias("sections"))
    m = mapping.agg(F.count_distinct("work_key").alias("mappings"))
    return w.crossJoin(s).crossJoin(m)  # one row each


def by_title(rows: DataFrame, column: str = "title") -> DataFrame:
    """Rows in the order a reader expects: case and accents come after letters."""
    return rows.orderBy(F.collate(column, "UNICODE"))


def browsed(works: DataFrame, groups: DataFrame) -> DataFrame:
    """The whole library from category to edition to work: a row for each work and category, with the edition's shown title, its works and readable works there, and the work's place in the edition by title, as a reader sorts titles."""
    rows = categories_of(works, groups)
    shelf = Window.partitionBy("category_id", "edition_id")
    place = F.row_number().over(shelf.orderBy(F.collate(F.coalesce("title", F.lit("")), "UNICODE"), "key"))
    counted = rows.withColumns({"edition": text.friendly_title(F.col("edition_title"), F.col("edition_id")), "records": F.count(F.lit(1)).over(shelf), "readable": F.count_if(_is("content_state", READABLE)).over(shelf), "place": place})
    return counted.select("category_id", "edition_id", "edition", "records", "readable", "place", "key", "title")
