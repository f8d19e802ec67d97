"""SQL functions against the DataFrame functions, and summaries that add up."""

from conftest import SF
from pyspark.sql import functions as F

from lexiquarry.operators import crossrefs, search, sketches
from lexiquarry.plans import sql_surface, surface_queries

TEXTS = [(1, "1", 0, "The word's end; the END"), (1, "2", 0, "the"), (2, "1", 0, None), (2, "1", 1, ""), (3, "x", 0, "Das Ende É the word"), (4, "1", 0, "d'or word's the-the the’")]
LINKS = [("a", "Gen. 1:1"), ("b", "gen 1:1-3"), ("c", "Gen  1:1,4"), ("d", "Gen 1:10"), ("e", None), ("f", "Gen 1:1 f")]


def test_functions_of_sql(spark):
    segments = spark.createDataFrame(TEXTS, "work_index long, chapter string, seg_idx long, text string")
    links = spark.createDataFrame(LINKS, "source string, reference string")
    sql_surface.register(spark, *sql_surface.views(segments, links, "test"))
    for query in ("the word", "The  END", "x", " ", "é the", "word's", "nothing here"):
        want = search.search_all_terms(segments, query, ["work_index", "chapter", "seg_idx"]).collect()
        assert spark.sql("SELECT * FROM lexi_search(:q)", {"q": query}).collect() == want, query
    for term in ("THE", "word's", "É", "!!", "the-the"):
        want = search.concordance_hits(segments, term).groupBy("work_index").agg(F.sum("count").alias("n"))
        assert sorted(map(tuple, spark.sql("SELECT * FROM lexi_concordance(:q)", {"q": term}).collect())) == sorted(map(tuple, want.collect())), term
    for target in ("GEN 1:1", "Gen. 1:10", "gen", "", "Gen 1:1-3"):
        want = crossrefs.backlinks(links, spark.createDataFrame([(target,)], "target string")).select("source", "reference")
        got = spark.sql("SELECT * FROM lexi_backlinks(:t)", {"t": target}).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) if target else not got, target


def test_summaries_add_up(spark):
    rows = spark.range(3000).select(F.col("id").alias("work_index"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 40 + 1).cast("int")), lambda k: F.concat(F.lit("t"), (F.col("id") * 7 + k) % 5000))).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(5, None), (6, "")], "work_index long, text string"))
    parts = sketches.by_shard(rows, shards=16)
    assert parts.count() == 16
    want = rows.select(F.explode(F.array_distinct(F.split("text", " "))).alias("t")).filter("t <> ''").distinct().count()
    for chosen in (list(range(16)), [2, 3, 9]):
        one = sketches.merged(parts.filter(F.col("shard").isin(chosen))).select("n", sketches.distinct_tokens().alias("t"), sketches.length_at(0.5).alias("m"), sketches.rank_of(100).alias("r")).first()
        some = rows.filter((F.col("work_index") % 16).isin(chosen))
        exact = some.select(F.explode(F.array_distinct(F.split("text", " "))).alias("t")).filter("t <> ''").distinct().count()
        assert one["n"] == some.count() and abs(one["t"] - exact) <= 4 * 0.0163 * exact + 1
        share = lambda c: some.filter("text IS NOT NULL").agg(F.avg(c.cast("int"))).first()[0]
        assert share(F.length("text") <= one["m"]) >= 0.46 and share(F.length("text") < one["m"]) <= 0.54 and abs(one["r"] - share(F.length("text") <= 100)) <= 0.04
    twice = sketches.merged(sketches.merged(parts, "shard").unionByName(parts.select("shard", "n", "tokens", "lengths"))).select(sketches.distinct_tokens().alias("t")).first()["t"]
    assert abs(twice - want) <= 4 * 0.0163 * want + 1
    assert sketches.merged(parts.limit(0), "shard").count() == 0


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_backlinks_in_sql_meet_by_equality(spark):
    links = spark.createDataFrame([("a", "Gen. 1:1"), ("b", "gen 1:1-3,5"), ("c", "Gen 1:10"), ("d", None), ("e", "gen 1:1,1:1")], "source string, reference string")
    segments = spark.createDataFrame([], "work_index long, chapter string, seg_idx long, text string")
    sql_surface.register(spark, *sql_surface.views(segments, links, "equal"))
    asked = spark.createDataFrame([("GEN  1:1",), ("gen 1:1-3",), ("",), (None,)], "target string")
    asked.createOrReplaceTempView("equal_asked")
    found = spark.sql("SELECT o.target, b.source FROM equal_asked AS o, LATERAL lexi_backlinks(o.target) AS b")
    assert sorted(map(tuple, found.collect())) == [("GEN  1:1", "a"), ("GEN  1:1", "b"), ("GEN  1:1", "e"), ("gen 1:1-3", "b")]
    assert "NestedLoop" not in _plan(found) and "CartesianProduct" not in _plan(found)


def test_no_text_is_shuffled_for_sketch_bounds(spark):
    """The group of all shards holds half of the rows: they must not meet its summary in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(surface_queries.sketch_bounds(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1
