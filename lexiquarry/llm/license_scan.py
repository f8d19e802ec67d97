"""License scans: ordered signature rules over whole texts.

A text's words decide which rules can match: a rule runs only if all of its keywords are among them, which for most
texts leaves none. Matches are spans of words. Rules go by their order: a match is dropped if its span lies within that
of a match kept before it, so "GNU General Public License, version 3" isn't also a match of the rule for the license
without a version. Each row is looked at where it is read; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import RULES

#: Phrases whose every place counts and whose labels always stay.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Lower-cases A-Z and makes blanks of what is no letter, digit or byte beyond ASCII.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    place: int
    label: str
    weight: float
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]


class Match(NamedTuple):
    label: str
    weight: float
    first: int
    last: int


def parsed(table: str) -> list[Rule]:
    """The rules of a table, a line each: label | weight | keywords | pattern, in order of priority."""
    out = []
    for line in table.strip().splitlines():
        label, weight, keywords, pattern = line.split("|", 3)
        out.append(Rule(len(out), label, float(weight), frozenset(keywords.encode().split()), re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")))
    return out


class Scanner:
    """Rules by the keyword that the fewest rules share."""

    def __init__(self, rules: list[Rule]) -> None:
        shared: dict[bytes, int] = {}
        for rule in rules:
            for word in rule.keywords:
                shared[word] = shared.get(word, 0) + 1
        self.gates: dict[bytes, list[Rule]] = {}
        for rule in rules:
            self.gates.setdefault(min(rule.keywords, key=lambda w: (shared[w], w)), []).append(rule)
        self.base = {phrase.encode(): label for phrase, label in BASE.items()}

    def candidates(self, words: set[bytes]) -> list[Rule]:
        return sorted((r for gate in self.gates.keys() & words for r in self.gates[gate] if r.keywords <= words), key=lambda r: r.place)

    def matches(self, line: bytes, rules: list[Rule]) -> list[Match]:
        """Kept matches in a line of words with a blank around each, by rule and place."""
        found = [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(line)]
        starts, ends, out = [], [], []  # spans of the kept matches that lie in no other, by start and so by end
        for lo, hi, rule in found:
            k = bisect_right(starts, lo)  # the last of those that begin no later reaches furthest
            if k and ends[k - 1] >= hi:
                continue
            out.append((lo, hi, rule))
            first, last = bisect_left(starts, lo), bisect_right(ends, hi)
            starts[first:last], ends[first:last] = [lo], [hi]
        at, place, count = {}, 0, 0
        for byte in sorted({b for lo, hi, _ in out for b in (lo, hi)}):
            count += line.count(b" ", place, byte)
            at[byte], place = count, byte
        return [Match(rule.label, rule.weight, at[lo] - 1, at[hi] - 1) for lo, hi, rule in out]

    def scan(self, text: bytes) -> dict:
        """What scanned() says of a text."""
        words = text.translate(WORDS).split()
        known = set(words)
        line = b" " + b" ".join(words) + b" "
        rules = self.candidates(known)
        kept = self.matches(line, rules) if rules else []
        places, labels = [], []
        for phrase, label in self.base.items():
            if known.issuperset(phrase.split()):
                at = byte = 0
                while (found := line.find(b" " + phrase + b" ", byte)) >= 0:
                    at += line.count(b" ", byte, found)
                    places.append(at)
                    labels.append(label)
                    at, byte = at + 1, found + 1
        return {
            "words": len(words), "base": len(places), "first": min(places, default=None), "last": max(places, default=None),
            "base_labels": ",".join(sorted(set(labels))), "labels": ",".join(sorted({*labels, *(m.label for m in kept)})),
            "score": max((m.weight for m in kept), default=0.0), "matches": [m._asdict() for m in kept],
        }


@lru_cache(maxsize=4)
def scanner(table: str) -> Scanner:
    return Scanner(parsed(table))


_RESULT = "words bigint, base bigint, first bigint, last bigint, base_labels string, labels string, score double, matches array<struct<label:string,weight:double,first:bigint,last:bigint>>"
_ARROW = pa.schema([("words", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("weight", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])))])


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: str = RULES) -> DataFrame:
    """Of each row: its id and words, base, first, last (places of base phrases), base_labels, labels, score and matches (label, weight, first and last word).

    A null text is empty. An empty text, or one without words, has 0 words, no places (null first and last), empty labels
    and score 0. The score is the greatest weight of a kept match, 0 where there is none. Texts are scanned whole, of any
    length; rows that repeat, and null ids, are rows like others; other columns, whatever their names, aren't read. An
    empty table gives an empty one. Of matches with one span the earlier rule's stays; matches that cross stay both.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            found = pa.RecordBatch.from_pylist([own.scan(t.as_py()) for t in batch.column(1)], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[id, *_ARROW.names])

    rows = docs.select(F.col(id), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    return rows.mapInArrow(run, f"`{id}` {kind}, {_RESULT}")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents."""
    done = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.col("words").alias("n_words"), F.col("base").alias("n_base"), F.col("first").alias("first_word"), F.col("last").alias("last_word"), "base_labels", "labels", "score")


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES: dict[str, str] = {}
