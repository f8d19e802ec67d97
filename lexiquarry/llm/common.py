"""What the operators share: tables in the cluster's shared folder, joins that hot keys don't slow, word patterns."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key that make it hot: one part in so many of all rows. At most as many keys can be hot.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine, and only where it is unset, a temporary folder is set; elsewhere that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said:
        said = spark.sparkContext._jsc.sc().getCheckpointDir()
        said = said.get() if said.isDefined() else None
    if not said:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lexiquarry-{name}-{uuid.uuid4().hex}"


#: The open lists of this thread's (or task's) stashes(): runs in other threads don't see them.
_watched: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("lexiquarry_watched", default=())


@contextlib.contextmanager
def stashes() -> Iterator[list[str]]:
    """The paths of the tables that this thread writes meanwhile, for a caller who knows when they are no longer read. Nothing else deletes them."""
    made: list[str] = []
    before = _watched.get()
    _watched.set((*before, made))
    try:
        yield made
    finally:
        _watched.set(before)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written meanwhile, but for those that the given function is called on."""
    spared: set[str] = set()

    def spare(df: DataFrame) -> DataFrame:
        spared.add(df._lexiquarry_path)
        return df

    with stashes() as made:
        yield spare
    gone = [p for p in made if p not in spared]
    remove(spark, gone)
    for outer in _watched.get():
        outer[:] = [p for p in outer if p not in gone]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders by the file system that they are in, and the catalogue's entries of bucketed tables."""
    for path in paths:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _noted(df: DataFrame, path: str) -> DataFrame:
    df._lexiquarry_path = path
    return df


def _path(spark: SparkSession, name: str) -> str:
    path = scratch(spark, name)
    for made in _watched.get():
        made.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder, and read again: computed once, its lineage cut, columns still prunable."""
    path = _path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path), path)


def cut(df: DataFrame) -> DataFrame:
    """stash() for a small table of a loop."""
    return stash(df, "cut")


#: Bits of a row number that count rows within a task; the rest is the task's number.
PLACE_BITS = 40
_tables: dict[str, str] = {}


def _buckets(df: DataFrame) -> int:
    """Twice the tasks that a scan of the frame's size takes, or that a shuffle takes."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // each if size < 1 << 60 else 0)
    return min(20_000, 2 * tasks)


def bucketed(df: DataFrame, key: str, name: str, like: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The frame written in buckets of a column, from which joins by that column alone start without a shuffle of this side.

    Unless their number is given, there are as many buckets as a frame of the size of `like` (df, where none is given) needs; a join's own size is only a bound.
    """
    spark, path = df.sparkSession, _path(df.sparkSession, name)
    table = f"lexiquarry_{re.sub('[^a-z0-9]', '_', name)}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets or _buckets(df if like is None else like), key).option("path", path).saveAsTable(table)
    _tables[path] = table
    return _noted(spark.table(table), path)


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """The frame bucketed by <row>_part. row: the task's number and, from 0 without gaps, the row's place in it, as PLACE_BITS says.

    attached() brings columns to such a table without moving its rows.
    """
    return bucketed(df.withColumn(row + "_part", F.shiftright(row, PLACE_BITS).cast("int")), row + "_part", name)


def attached(table: DataFrame, narrow: DataFrame, row: str, into: str) -> DataFrame:
    """table (of numbered()) with a struct `into` of narrow's columns, null where narrow(row, ...), unique by row, has none.

    Only row numbers and narrow's columns are shuffled: each part's become an array in the order of its rows, as long
    as the task that wrote the part read rows, and the bucketed side stays where it is.
    """
    part, others = row + "_part", [c for c in narrow.columns if c != row]
    found = narrow.select(row, F.struct(*others).alias(into))
    every = table.select(part, row).join(found, row, "left")
    arrays = every.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(row, into))).alias(into + "_rows"))
    place = F.col(row).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    out = table.join(arrays.hint("shuffle_hash"), part)
    return out.withColumn(into, F.get(into + "_rows", place)[into]).drop(into + "_rows", part)


def finite(column: str) -> Column:
    """Not null, and no component null, infinite or not a number."""
    v = F.col(column)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(docs: DataFrame, ids: DataFrame, salt: str, rows: int, size: int, group: str, each: int | None = None) -> DataFrame:
    """(doc_id, group) of ids(doc_id, group): of each group the first by a hash of doc_id, until all groups together have `rows` of them, a group `each`, or a group's texts `size` bytes.

    Groups take turns, so a small one isn't crowded out. Texts of any length count alike; each group has one at least. What
    comes out is at most `rows` rows.
    """
    order, most = (F.xxhash64(F.lit(salt), "doc_id"), "doc_id"), min(rows, each or rows)
    # a group's ids are dealt over parts first, so that no task ranks all of a large group
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(32))
    near = ids.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))).filter(F.col("place") <= most)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = cut(near.withColumn("place", place).filter(F.col("place") <= most).orderBy("place", group).limit(rows).drop("part"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).join(F.broadcast(first), "doc_id").groupBy("doc_id", group, "place").agg(F.sum("n").alias("n"))
    so_far = sizes.withColumn("so_far", F.sum("n").over(Window.partitionBy(group).orderBy("place")))
    return cut(so_far.filter((F.col("so_far") <= size) | (F.col("so_far") == F.col("n"))).select("doc_id", group))


def lookup_join(left: DataFrame, right: DataFrame, key: str, n: str, small: int = 100_000) -> DataFrame:
    """Left outer join with right, which has one row for each key and, in column n, the number of left's rows with it.

    right must be cheap to read twice. Up to `small` counted rows are broadcast. Beyond, keys with at least
    1/HOT_PARTS of the rows (so at most HOT_PARTS keys) are broadcast, and the rest, none of them hot, is shuffled.
    """
    rows, total = right.agg(F.count(F.lit(1)), F.sum(n)).first()
    if rows <= small:
        return left.join(F.broadcast(right.drop(n)), key, "left")
    hot = F.col(n) * HOT_PARTS >= F.lit(total or 0)
    heavy = F.broadcast(right.filter(hot).drop(n))
    return left.join(heavy, key, "inner").unionByName(left.join(heavy.select(key), key, "left_anti").join(right.filter(~hot).drop(n), key, "left"))
