"""A user's state from an append-only log of events.

events: event_id, ts, user_id, kind, work, chapter, passage, value. Every fold is ordered by (ts, event_id), so a
rerun gives the same state, and the log is never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text

HISTORY = 100
COLOUR = "gold"


def _when() -> Column:
    return F.struct("ts", "event_id")


def last_by(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The last value of each key (positions)."""
    return events.groupBy(*keys).agg(F.max_by(value, _when()).alias(value), F.max("ts").alias("updated_at"))


def toggles(events: DataFrame, keys: list[str], value: str | None = None, default: str = COLOUR) -> DataFrame:
    """Keys that an odd number of events switched on, with the last one's time and value (bookmarks, highlights)."""
    rows = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("created_at"), *([text.filled(F.max_by(value, _when()), F.lit(default)).alias(value)] if value else []))
    return rows.filter("n % 2 = 1").drop("n")


def notes(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The last note of each key; a blank one deletes."""
    return last_by(events, keys, value).filter(~text.is_blank(F.col(value)))


def history(events: DataFrame, user: list[str], reference: list[str], most: int = HISTORY) -> DataFrame:
    """Each user's latest visit of each reference, newest first, at most so many: (user, reference, ts, place)."""
    latest = events.groupBy(*user, *reference).agg(F.max(_when()).alias("at"))
    ranked = latest.withColumn("place", F.row_number().over(Window.partitionBy(*user).orderBy(F.desc("at"), *reference)))
    return ranked.filter(F.col("place") <= most).select(*user, *reference, F.col("at.ts").alias("ts"), "place")


def removals(events: DataFrame, user: list[str]) -> DataFrame:
    """(user, work, removed): the (ts, event_id) of each work's last removal that found it imported; a removal of what isn't imported does nothing."""
    by = Window.partitionBy(*user, "work").orderBy("ts", "event_id")
    rows = events.filter(F.col("kind").isin("import", "remove-import")).withColumn("_before", F.lag("kind").over(by))
    return rows.filter("kind = 'remove-import' AND _before = 'import'").groupBy(*user, "work").agg(F.max(_when()).alias("removed"))


def since_removal(events: DataFrame, removed: DataFrame, user: list[str]) -> DataFrame:
    """Events that no later removal of their work takes along. Toggles, notes, positions and history are folded from these; collections and plans aren't."""
    both = events.join(removed, [*user, "work"], "left")
    return both.filter(F.col("removed").isNull() | (_when() > F.col("removed"))).select(*events.columns)


#: Kinds of events of a reader's whole state; those of TAKEN_ALONG go with the removal of an imported work.
TAKEN_ALONG = ("bookmark", "highlight", "note", "position", "visit")
KEPT = ("collection", "plan")


def entries(events: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, kind, work, chapter, passage, value, ts) of each reader's state: what is on after all events(user, kind, work, chapter, passage, value, ts, event_id).

    Bookmarks and highlights are toggled (a highlight without a colour is gold). Notes, positions, collections and plans
    hold the last value; a blank note, collection or plan is deleted, and a position is its work's, a collection's or
    plan's id is the work. A visit's time is its last. The removal of a work that was imported takes its entries along,
    not so collections and plans. Null parts of a key are empty. Events of other kinds do nothing.
    """
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("work", "chapter", "passage")}
    by_work = F.col("kind").isin("position", *KEPT)
    rows = events.withColumns(blank).withColumns({c: F.when(by_work, F.lit("")).otherwise(F.col(c)) for c in ("chapter", "passage")})
    left = since_removal(rows.filter(F.col("kind").isin(*TAKEN_ALONG)), removals(rows, [user]), [user])
    keys = [user, "kind", "work", "chapter", "passage"]
    last = left.unionByName(rows.filter(F.col("kind").isin(*KEPT))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", _when()).alias("value"), F.max("ts").alias("ts"))
    value = F.when(F.col("kind") == "highlight", text.filled(F.col("value"), F.lit(COLOUR))).when(F.col("kind").isin("bookmark", "visit"), F.lit(None)).otherwise(F.col("value"))
    toggled = F.col("kind").isin("bookmark", "highlight")
    on = F.when(toggled, F.col("n") % 2 == 1).when(F.col("kind").isin("note", *KEPT), ~text.is_blank(F.col("value"))).otherwise(True)
    return last.filter(on).select(*keys, value.alias("value"), "ts")


HISTORY_SHOWN = 30


def library_lists(entries_: DataFrame, works: DataFrame, user: str = "user_id", shown: int = HISTORY_SHOWN) -> DataFrame:
    """A reader's lists: entries() of each kind by recency, with place (from 1) and their works' titles; of visits the last `shown`. Entries of unknown works aren't shown."""
    rows = with_work(entries_, works)
    place = F.row_number().over(Window.partitionBy(user, "kind").orderBy(F.desc("ts"), "work", "chapter", "passage"))
    return rows.withColumn("place", place).filter((F.col("kind") != "visit") | (F.col("place") <= shown))


def import_title(title: Column) -> Column:
    """Trimmed; what is missing, empty or blank is "Imported book"."""
    return text.filled(text.trimmed(title), F.lit("Imported book"))


def import_source(source: Column) -> Column:
    return text.filled(source, F.lit("local import"))


def import_id(source: Column, title: Column, chapters: Column) -> Column:
    """An import's id from what it holds, its source and title with their defaults; chapters is its JSON without spaces."""
    held = F.concat_ws("\n", import_source(source), import_title(title), F.coalesce(chapters, F.lit("")))
    return F.concat(F.lit("u-"), hashing.base36(hashing.fnv1a(held)))


def with_import_key(imports: DataFrame) -> DataFrame:
    """imports(id, source, title, chapters, ...) with key, and defaults for source and title; a null or empty id is made of the content, so the same import twice has one key."""
    made = text.filled(F.col("id"), import_id(F.col("source"), F.col("title"), F.to_json("chapters")))
    rows = imports.withColumns({"id": made, "source": import_source(F.col("source")), "title": import_title(F.col("title"))})
    return rows.withColumn("key", F.concat(F.lit("import/"), "id"))


def replaced(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current without the rows whose keys new has, then new's: an upsert in which the new row wins."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def saved(current: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("description", "created_at")) -> DataFrame:
    """replaced() by (user, id) for collections and plans: the named columns keep their old values where new says nothing, and created_at always does."""
    keys = ["user", "id"]
    old = current.select(*keys, F.struct(*kept).alias("_old"))
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(c)) if c == "created_at" else F.coalesce(F.col(c), F.col(f"_old.{c}"))
    rows = new.join(old, keys, "left").select(*(value(c).alias(c) if c in kept else F.col(c) for c in new.columns))
    return replaced(current, rows, keys)


def removed_row(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """current without the rows that gone names; a name that current lacks does nothing."""
    return current.join(gone.select(*keys), keys, "left_anti")


def item_key() -> list[Column]:
    """What makes two items of a collection the same: five fields, empty ones equal to missing ones."""
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return [blank("type", "passage"), *(blank(c, "") for c in ("work", "chapter", "passage", "source"))]


def plan_steps(column: str) -> Column:
    """A plan's steps (id, label, work, chapter, complete) with their defaults filled in."""

    def one(s: Column, k: Column) -> Column:
        number = (k + 1).cast("string")
        return F.struct(F.coalesce(s["id"], number).alias("id"), text.filled(s["label"], s["work"], F.concat(F.lit("Step "), number)).alias("label"), F.coalesce(s["work"], F.lit("")).alias("work"), text.filled(s["chapter"], F.lit("1")).alias("chapter"), F.coalesce(s["complete"], F.lit(False)).alias("complete"))

    return F.transform(F.coalesce(F.col(column), F.array()), one)


def personal_items(notes_: DataFrame, bookmarks: DataFrame, work: str | None = None, chapter: str | None = None, passage: str | None = None) -> DataFrame:
    """Notes and bookmarks (user, work, chapter, passage, text) with their type, all or those of a passage; keys are compared as texts."""
    both = notes_.withColumn("type", F.lit("note")).unionByName(bookmarks.withColumn("type", F.lit("bookmark")), allowMissingColumns=True)
    for name, value in (("work", work), ("chapter", chapter), ("passage", passage)):
        if value is not None:
            both = both.filter(F.col(name).cast("string") == str(value))
    return both


def with_work(rows: DataFrame, works: DataFrame) -> DataFrame:
    """Annotations with their work's title and edition; those whose work is unknown aren't shown."""
    return rows.join(works.select(F.col("key").alias("work"), F.col("title").alias("work_title"), F.col("edition_title").alias("work_edition")), "work")


def dashboard(parts: dict[str, DataFrame], user: list[str]) -> DataFrame:
    """(user, kind, n): how much of each kind every user has who has any, zeros included."""
    counts = None
    for kind, rows in parts.items():
        one = rows.groupBy(*user).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        counts = one if counts is None else counts.unionByName(one)
    kinds = F.explode(F.array(*map(F.lit, parts))).alias("kind")
    return counts.select(*user).distinct().select(*user, kinds).join(counts, [*user, "kind"], "left").select(*user, "kind", F.coalesce("n", F.lit(0)).alias("n"))


def with_step(plans: DataFrame, plan: str, step: int, complete: bool) -> DataFrame:
    """plans(id, steps) with one step set."""
    one = F.transform("steps", lambda s, k: F.when(k == step, s.withField("complete", F.lit(complete))).otherwise(s))
    return plans.withColumn("steps", F.when(F.col("id") == plan, one).otherwise(F.col("steps")))


def progress(plans: DataFrame) -> DataFrame:
    """Done steps, all steps and the percentage."""
    done = F.size(F.filter("steps", lambda s: F.coalesce(s["complete"], F.lit(False))))
    return plans.select("id", done.alias("done"), F.size("steps").alias("steps"), F.round(100 * done / F.greatest(F.size("steps"), F.lit(1))).alias("percent"))


def annotated(segments: DataFrame, bookmarks: DataFrame, highlights: DataFrame, remarks: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of a chapter with the user's marks."""
    rows = segments.join(bookmarks.select(*keys, F.lit(True).alias("bookmarked")), keys, "left").join(highlights.select(*keys, F.col("value").alias("colour")), keys, "left")
    return rows.join(remarks.select(*keys, F.col("value").alias("note")), keys, "left").withColumn("bookmarked", F.coalesce("bookmarked", F.lit(False)))


def chapter_or_first(chapters: DataFrame, work: str, asked: str | None, remembered: str | None) -> DataFrame:
    """The chapter that opens: the one asked for, else the remembered one, else the first; a missing one gives the first."""
    want = asked or remembered
    order = [F.desc(F.col("chapter").eqNullSafe(F.lit(want))), "chapter_ord"]
    return chapters.filter(F.col("work_key") == work).orderBy(*order).limit(1)
