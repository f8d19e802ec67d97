"""Full-text search, scored retrieval, concordance, and the token index with its bloom filters.

A segment table has at least: an order key, text, and what the caller wants to see. Every limit has a total order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text

SEARCH_LIMIT, RETRIEVE_LIMIT, CHAPTER_LIMIT, GROUNDING_LIMIT, CONCORDANCE_LIMIT, LINKED_LIMIT = 200, 18, 10, 30, 100, 14
PHRASE_LENGTH, PHRASE_BONUS, TERM_SCORE = 6, 8, 3
PROMPT_ITEMS, PROMPT_ITEM_BYTES, PROMPT_BYTES = 24, 5000, 36000
PREFERRED_MODEL = "llama3.2:3b"


def _terms(frame: DataFrame, expression: Column) -> list[str]:
    """A constant expression's value; the optimiser folds it, no table is read."""
    return list(frame.sparkSession.range(1).select(expression.alias("t")).first()["t"])


def matches_all(segments: DataFrame, query: str, text_column: str = "text") -> DataFrame:
    """Segments whose tokens hold all of the query's tokens. A query under two characters or without tokens finds nothing."""
    terms = _terms(segments, text.search_tokens(F.trim(F.lit(query)))) if len(query.strip()) >= 2 else []
    if not terms:
        return segments.limit(0)
    tokens = text.search_tokens(F.col(text_column))
    # containment as a substring is implied and cheap, so most rows never meet the tokenizer
    near = [F.lower(F.col(text_column)).contains(t) for t in terms]
    cheap = near[0]
    for n in near[1:]:
        cheap = cheap & n
    return segments.filter(cheap).filter(F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0)


def search_all_terms(segments: DataFrame, query: str, order: list[str], limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first matches in scan order, unranked."""
    return matches_all(segments, query).orderBy(*order).limit(limit)


def search_with_imports(segments: DataFrame, imports: DataFrame, query: str, order: list[str], limit: int = SEARCH_LIMIT) -> DataFrame:
    """Matches of the corpus, then of a user's imports; both need the same columns."""
    found = matches_all(segments, query).withColumn("imported", F.lit(False)).unionByName(matches_all(imports, query).withColumn("imported", F.lit(True)))
    return found.orderBy("imported", *order).limit(limit)


def term_score(text_column: str, terms: list[str]) -> Column:
    lowered = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    return sum((lowered.contains(t).cast("int") for t in terms), F.lit(0)) * TERM_SCORE


def retrieve(segments: DataFrame, question: str, order: list[str], limit: int = RETRIEVE_LIMIT) -> DataFrame:
    """The best segments by terms found as substrings, with a bonus for the whole question; ties in scan order."""
    terms = _terms(segments, text.query_terms(F.lit(question)))
    if not terms:
        return segments.withColumn("score", F.lit(0)).limit(0)
    phrase = question.strip().lower()
    bonus = F.when(F.lower("text").contains(phrase), PHRASE_BONUS).otherwise(0) if len(phrase) >= PHRASE_LENGTH else F.lit(0)
    scored = segments.withColumn("found", term_score("text", terms)).filter("found > 0")
    return scored.withColumn("score", F.col("found") + bonus).drop("found").orderBy(F.desc("score"), *order).limit(limit)


def chapter_context(segments: DataFrame, question: str, chapter: list[str], order: list[str], limit: int = CHAPTER_LIMIT) -> DataFrame:
    """The best segments of every chapter; where none has a term, its first ones."""
    terms = _terms(segments, text.query_terms(F.lit(question)))
    scored = segments.withColumn("score", term_score("text", terms) if terms else F.lit(1))
    scored = scored.withColumn("best", F.max("score").over(Window.partitionBy(*chapter)))
    ranked = scored.filter("score > 0 OR best = 0").withColumn("place", F.row_number().over(Window.partitionBy(*chapter).orderBy(F.desc("score"), *order)))
    return ranked.filter(F.col("place") <= limit).drop("best")


def grounding(producers: list[DataFrame], order: list[str], limit: int = GROUNDING_LIMIT) -> DataFrame:
    """Items (id, text, ...) of several producers in order of priority; the first of an id counts, blank ones don't."""
    tagged = [p.withColumn("producer", F.lit(k)) for k, p in enumerate(producers)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    good = union.filter(F.coalesce(F.col("id"), F.lit("")) != "").filter(~text.is_blank(F.col("text")))
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("producer", *order))).filter("nth = 1").drop("nth")
    return first.orderBy("producer", *order).limit(limit)


def linked(grounded: DataFrame, order: list[str], limit: int = LINKED_LIMIT) -> DataFrame:
    """The first grounding items, with the label that a reader sees."""
    return grounded.orderBy(*order).limit(limit).withColumn("label", F.concat(F.lit("["), "id", F.lit("] "), F.coalesce("title", F.lit(""))))


def model_names(models: DataFrame, key: list[str], column: str = "models") -> DataFrame:
    """(key, names, preferred) of a column of structs (name, model): the distinct filled names in first-seen order, and the preferred one or else the first."""
    names = F.array_distinct(F.filter(F.transform(column, lambda m: text.filled(text.trimmed(m["name"]), text.trimmed(m["model"]))), lambda n: n.isNotNull()))
    wanted = F.get(F.filter(names, lambda n: F.lower(n) == PREFERRED_MODEL), F.lit(0))
    return models.select(*key, names.alias("names"), F.coalesce(wanted, F.get(names, F.lit(0)), F.lit("")).alias("preferred"))


def prompt_budget(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Bytes of each item (id, text) that a prompt takes: so many items looked at, so many bytes each and in all; blank ones take none."""
    by = Window.partitionBy(*group).orderBy(*order)
    seen = items.withColumn("ordinal", F.row_number().over(by)).filter(F.col("ordinal") <= PROMPT_ITEMS)
    good = seen.filter(~text.is_blank(F.col("id")) & ~text.is_blank(F.col("text")))
    long = good.withColumn("want", F.least(F.lit(PROMPT_ITEM_BYTES), F.octet_length(text.trimmed(F.col("text")))))
    before = F.coalesce(F.sum("want").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return long.withColumn("before", before).filter(F.col("before") < PROMPT_BYTES).withColumn("bytes", F.least(F.col("want").cast("long"), F.lit(PROMPT_BYTES) - F.col("before"))).drop("want", "before")


def prompt_items(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """prompt_budget()'s items with their texts cut to what the prompt takes."""
    return prompt_budget(items, group, order).withColumn("text", text.first_bytes(text.trimmed(F.col("text")), F.col("bytes").cast("int"))).filter("text <> ''")


def prompts(items: DataFrame, question: str, group: list[str], order: list[str], preamble: str = "") -> DataFrame:
    """(group, prompt, ids): the question and the items (id, kind, title, text) under the budget, as a model is asked; at most PROMPT_ITEMS items a group."""
    filled = lambda c, before, after: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    entry = F.concat(F.lit("\n["), text.trimmed(F.col("id")), F.lit("]"), filled("kind", " (", ")"), filled("title", " ", ""), F.lit("\n"), "text", F.lit("\n"))
    rows = prompt_items(items, group, order).select(*group, F.struct("ordinal", text.trimmed(F.col("id")).alias("id"), entry.alias("entry")).alias("e"))
    by = rows.groupBy(*group).agg(F.array_sort(F.collect_list("e")).alias("e"))
    head = f"{preamble}QUESTION:\n{question.strip()}\n\nLOCAL CONTEXT:\n"
    return by.select(*group, F.concat(F.lit(head), F.array_join(F.transform("e", lambda x: x["entry"]), "")).alias("prompt"), F.transform("e", lambda x: x["id"]).alias("ids"))


def with_works(hits: DataFrame, works: DataFrame, on: str = "work_index") -> DataFrame:
    """Hits with their work's key, title and edition; hits of unknown works are dropped. Whether works are broadcast is left to their measured size."""
    return hits.join(works.select(on, F.col("key").alias("work_key"), F.col("title").alias("work_title"), "edition_title"), on)


def concordance_hits(segments: DataFrame, term: str) -> DataFrame:
    """Segments with the word, and how often each has it."""
    needle = segments.sparkSession.range(1).select(text.word_norm(F.lit(term)).alias("n")).first()["n"]
    if not needle:
        return segments.withColumn("count", F.lit(0).cast("long")).limit(0)
    words = text.concordance_words(F.col("text"))
    count = F.size(F.filter(words, lambda w: text.word_norm(w) == needle)).cast("long")
    return segments.withColumn("count", count).filter("count > 0")


def concordance_by_work(segments: DataFrame, term: str, work: str = "work") -> DataFrame:
    """Occurrences for each work, most first, then by name as a reader sorts names."""
    return concordance_hits(segments, term).groupBy(work).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.collate(F.col(work).cast("string"), "UNICODE"), work)


def concordance_of_works(segments: DataFrame, works: DataFrame, term: str, on: str = "work_index", limit: int = CONCORDANCE_LIMIT) -> DataFrame:
    """The works that use a word most, with titles."""
    counts = with_works(concordance_hits(segments, term).groupBy(on).agg(F.sum("count").alias("count")), works, on)
    return counts.orderBy(F.desc("count"), F.collate("work_title", "UNICODE"), on).limit(limit)


def concordance_total(segments: DataFrame, term: str) -> DataFrame:
    return concordance_hits(segments, term).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("hits"))


def shard_tokens(segments: DataFrame, index: str = "work_index", shards: int = hashing.SHARDS) -> DataFrame:
    """Distinct (shard, token): the inverted index that decides which shards a search must read."""
    return segments.select(hashing.shard_of(F.col(index), shards).alias("shard"), F.explode(F.array_distinct(text.search_tokens(F.col("text")))).alias("token")).distinct()


def shard_stats(segments: DataFrame, index: str = "work_index", shards: int = hashing.SHARDS) -> DataFrame:
    rows = segments.withColumn("shard", hashing.shard_of(F.col(index), shards))
    return rows.groupBy("shard").agg(F.count_distinct(index).alias("works"), F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))


def bloom_filters(tokens: DataFrame, bits: int = hashing.BLOOM_BITS, hashes: int = hashing.BLOOM_HASHES) -> DataFrame:
    """(shard, bloom) of (shard, token): bit k of a filter is bit k % 8 of byte k // 8. Positions are distinct before they meet, so a shard brings at most `bits` rows."""

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros(bits, np.uint8)
        mask[frame["bit"].to_numpy()] = 1
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "bloom": [np.packbits(mask, bitorder="little").tobytes()]})

    at = tokens.select("shard", F.explode(hashing.bloom_positions(F.col("token"), bits, hashes)).alias("bit")).distinct()
    return at.groupBy("shard").applyInPandas(fill, "shard int, bloom binary")


def might_hold(bloom: Column, token: Column, bits: int = hashing.BLOOM_BITS, hashes: int = hashing.BLOOM_HASHES) -> Column:
    """Whether all of the token's bits are set."""

    def bit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bloom, F.floor(p / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        return F.call_function("shiftright", byte, p % 8).bitwiseAND(F.lit(1)) == 1

    return F.forall(hashing.bloom_positions(token, bits, hashes), bit)


def shards_for(filters: DataFrame, query: str, any_term: bool = False) -> DataFrame:
    """Shards that may match a query's tokens: all of them, or any."""
    terms = _terms(filters, text.query_terms(F.lit(query)) if any_term else text.search_tokens(F.lit(query)))
    if not terms:
        return filters.select("shard").limit(0)
    test = might_hold(F.col("bloom"), F.lit(terms[0]))
    for t in terms[1:]:
        other = might_hold(F.col("bloom"), F.lit(t))
        test = (test | other) if any_term else (test & other)
    return filters.filter(test).select("shard")
