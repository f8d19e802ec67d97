"""Search, concordance and backlinks as SQL: temporary functions and table functions over views of segments and links.

    register(spark, "segments", "links")
    SELECT * FROM lexi_search('the word') JOIN works USING (work_index)

They are written in SQL, so a call is planned like the query that it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import SEARCH_LIMIT

#: Functions of one value; each may use those before it.
SCALARS = (
    ("lexi_tokens(t STRING) RETURNS ARRAY<STRING>", r"""regexp_extract_all(lower(coalesce(t, '')), r"[\p{L}\p{N}']{2,}", 0)"""),
    ("lexi_words(t STRING) RETURNS ARRAY<STRING>", r"""regexp_extract_all(coalesce(t, ''), r"[\p{L}\p{N}'’]+", 0)"""),
    ("lexi_word(w STRING) RETURNS STRING", r"""regexp_replace(lower(w), r"[^\p{L}\p{N}]+", '')"""),
    ("lexi_reference(t STRING) RETURNS STRING", r"""replace(lower(regexp_replace(regexp_replace(coalesce(t, ''), r"(?U)\s+", ' '), r"(?U)^[\s﻿]+|[\s﻿]+\z", '')), '.', '')"""),
)


def _tables(segments: str, links: str) -> tuple[tuple[str, str], ...]:
    folded = r"""regexp_replace(lower(w), r"[^\p{L}\p{N}]+", '')"""  # lexi_word: a lambda's body calls no function written in SQL
    return (
        (
            "lexi_search(query STRING) RETURNS TABLE(work_index BIGINT, chapter STRING, seg_idx BIGINT, text STRING)",
            f"""SELECT work_index, chapter, seg_idx, text FROM {segments} WHERE length(trim(query)) >= 2 AND size(lexi_tokens(query)) > 0 AND size(array_except(lexi_tokens(query), lexi_tokens(text))) = 0
                ORDER BY work_index, chapter, seg_idx LIMIT {SEARCH_LIMIT}""",
        ),
        (
            "lexi_concordance(term STRING) RETURNS TABLE(work_index BIGINT, occurrences BIGINT)",
            f"""SELECT work_index, sum(n) AS occurrences FROM (SELECT work_index, size(filter(words, w -> {folded} = needle)) AS n FROM (SELECT work_index, lexi_words(text) AS words, lexi_word(term) AS needle FROM {segments}) WHERE needle <> '')
                WHERE n > 0 GROUP BY work_index""",
        ),
        (
            "lexi_backlinks(target STRING) RETURNS TABLE(source STRING, reference STRING)",
            # a reference names all targets that it can match, itself and what ends before a dash or a comma, which meet the target by equality
            f"""SELECT source, reference FROM (SELECT source, reference, explode(array_distinct(transform(sequence(1, size(parts)), k -> array_join(slice(parts, 1, k), '')))) AS said
                FROM (SELECT source, reference, split(lexi_reference(reference), '(?=[-,])') AS parts FROM {links})) WHERE said <> '' AND said = lexi_reference(target)""",
        ),
    )


def register(spark: SparkSession, segments: str = "segments", links: str = "links") -> None:
    """Functions over the views segments(work_index, chapter, seg_idx, text) and links(source, reference); a later call replaces them."""
    for name, body in (*SCALARS, *_tables(segments, links)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")


def views(segments: DataFrame, links: DataFrame, prefix: str = "lexi") -> tuple[str, str]:
    """Names of temporary views of the two frames, for register()."""
    names = f"{prefix}_segments", f"{prefix}_links"
    segments.selectExpr("CAST(work_index AS BIGINT) AS work_index", "CAST(chapter AS STRING) AS chapter", "CAST(seg_idx AS BIGINT) AS seg_idx", "text").createOrReplaceTempView(names[0])
    links.selectExpr("CAST(source AS STRING) AS source", "reference").createOrReplaceTempView(names[1])
    return names
