"""Best-fit packing of documents into sequences.

Documents become token ids in one pass over the texts; the ids are written once and stay where they are. Of the pieces
only numbers and lengths move: they are dealt over groups of a set size by a hash, so that each sees all lengths
however the table was split, and each group packs its own best-fit, longest first. Bins that are nearly full are
done; the others climb a tree as items of their fill, and each round merges the leftovers of several groups and packs
them best-fit again, until one group is left or packing gains nothing. The places then travel back to the ids.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE_BITS, attached, cut, numbered, passing, stash

CAPACITY = 2048
#: A bin with at most so many free tokens is done.
SLACK = 8
#: Groups whose leftovers meet in one group of the next round.
FAN_IN = 8
#: Pieces in a group of the first round, about.
LEAF_ITEMS = 16_384
#: Items in a group of the tree at most; a task holds two numbers for each.
GROUP_ITEMS = 500_000
#: Words kept with their ids, for each worker.
CACHE = 800_000
#: Ids of the strings that the vocabulary's tokenizer takes as one token each wherever a text holds them. Fixed values.
SPECIAL = {"<|endoftext|>": 50256}
#: White space next to white space or to an end: the only places where cutting at single spaces could change ids.
_RUNS = re.compile(r"\s\s|\A\s|\s\Z|\x00")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """Ids of the byte-level BPE as little-endian unsigned 32-bit numbers: the same as byte_bpe_50k.json's, whose
    vocabulary the ranks file holds (a test compares them).

    The pattern that cuts texts before merging never joins across a single space or newline between other
    characters, so each word is encoded once, with the space before it, and its ids reused. Texts with other white
    space go as a whole. Strings of special tokens are those tokens.
    """

    def __init__(self, path: str, special: dict[str, int] = SPECIAL):
        self.encode, self.special = _encoding(path).encode_ordinary, special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = self[word] = np.asarray(self.encode(word), "<u4").tobytes()
        return ids

    def ordinary(self, text: str) -> bytes:
        # printable text has no white space but spaces, which is quick to know of most texts
        plain = text.replace("\n", "").isprintable() and not any(x in text for x in ("  ", " \n", "\n ", "\n\n")) and text[0] not in " \n" and text[-1] not in " \n"
        if not plain and _RUNS.search(text):
            return np.asarray(self.encode(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))

    def __call__(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.ordinary(text) if text else b""
        parts = self.marks.split(text)
        return b"".join(self.special[x].to_bytes(4, "little") if k % 2 else self.ordinary(x) for k, x in enumerate(parts) if x)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first have the full capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text): item_id, doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    A document is its ids, then id 0; null and empty texts are id 0 alone. Rows that repeat are pieces of their own.
    """
    path = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, end = Encoder(path), TaskContext.get().partitionId() << PLACE_BITS, bytes(4)
        for batch in batches:
            # a few long texts at a time, so that the ids of one batch stay small
            for lo in range(0, batch.num_rows, 512):
                out: list[list] = [[], [], [], [], [], []]
                part = batch.slice(lo, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = encode(text.as_py() or "") + end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        for column, value in zip(out, (at, doc, k, start, length, ids[4 * start : 4 * (start + length)])):
                            column.append(value)
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["item_id", "doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(pieces, "item_id long, doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills. Bins by free room, a bit set of rooms in use."""
    into, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        into[i], offset[i] = b, fills[b]
        fills[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return into, offset, np.asarray(fills, np.int64)


def assign(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, leaf_items: int = LEAF_ITEMS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """item_id, sequence_id and offset, gapless from 0, for items(item_id, length from 1 to capacity) with unique ids.

    No other column of items is read, so none clashes. Every bin that a round leaves underfull goes on to the next; the
    last round's bins are sequences as they are, so no item is lost. An empty table gives an empty one; the table given
    back is in the shared folder.
    """
    spark = items.sparkSession
    with passing(spark) as spare:
        n = items.count()
        groups = max(1, math.ceil(n / leaf_items))

        def leaf(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("item_id", ignore_index=True)
            into, offset, fills = best_fit(frame["length"].to_numpy(np.int64), capacity)
            return pd.DataFrame({"item_id": frame["item_id"], "bin": into + (int(key[0]) << 32), "offset": offset, "fill": fills[into]})

        dealt = items.select("item_id", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("leaf"))
        placed = stash(dealt.groupBy("leaf").applyInPandas(lambda k, f: leaf(k, f), "item_id long, bin long, offset long, fill long"), "placed")
        under = placed.filter((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
        level = cut(under.select("bin", F.col("bin").alias("top"), F.lit(0).cast("long").alias("base"), "fill"))
        n = level.count()

        def merge(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("bin", ignore_index=True)
            into, offset, fills = best_fit(frame["fill"].to_numpy(np.int64), capacity)
            tops = np.zeros(len(fills), np.int64)
            tops[into[::-1]] = frame["bin"].to_numpy()[::-1]  # a merged bin takes the id of one of its members
            return pd.DataFrame({"member": frame["bin"], "parent": tops[into], "shift": offset, "full": fills[into]})

        moved = level
        climbing = level.select("bin", "fill")
        while n and groups > 1:
            groups = max(math.ceil(groups / fan_in), math.ceil(n / group_items))
            rounds = climbing.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
            step = cut(rounds.groupBy("group").applyInPandas(lambda f: merge(f), "member long, parent long, shift long, full long"))
            joined = moved.join(step, moved["top"] == step["member"], "left")
            moved = cut(joined.select("bin", F.coalesce("parent", "top").alias("top"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"), F.coalesce("full", "fill").alias("fill")))
            climbing = step.filter((F.col("shift") == 0) & (F.col("full") < capacity - slack)).select(F.col("parent").alias("bin"), F.col("full").alias("fill"))
            before, n = n, climbing.count()
            if groups <= math.ceil(n / group_items) and n > 0.98 * before:
                break
        out = placed.join(moved.select("bin", "top", "base"), "bin", "left")
        return spare(stash(out.select("item_id", F.coalesce("top", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")), "assigned"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Packed pieces with their tokens: doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are one token, the end; null ids and rows that repeat are documents of their own; an empty table
    gives no pieces; a text of any length is cut into pieces. Columns of docs but doc_id and text aren't read.
    """
    return _placed(numbered(tokenized(docs, capacity, vocabulary), "item_id", "pieces"), capacity)


def _placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, a table of numbered(), with sequence_id and offset in place of item_id."""
    out = attached(pieces, assign(pieces.select("item_id", "length"), capacity), "item_id", "at")
    return out.select("*", "at.sequence_id", "at.offset").drop("item_id", "at")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every piece's place, with a checksum of its ids in their stead."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _placed(numbered(tokenized(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "item_id", "pieces"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
