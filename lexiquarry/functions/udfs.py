"""The few functions that no built-in can express, all in Arrow batches."""

from __future__ import annotations

import gzip
import html
import io
import json
import re
import unicodedata
import zipfile
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile("[̀-ͯ]")
#: Tokens of a side that word_diff is made of.
MOST_TOKENS = 250
#: Bytes of the table behind a difference that are held at a time, and of places of words; longer texts take their rows' square root.
ROWS_BYTES = 1 << 24
#: Texts that are Python strings at a time.
TEXTS_AT_ONCE = 100
_TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("kept", T.BooleanType())]))
DIFF = T.StructType([T.StructField("left", _TOKENS), T.StructField("right", _TOKENS), T.StructField("cut", T.BooleanType())])
MEMBERS = T.ArrayType(T.StructType([T.StructField("member", T.StringType()), T.StructField("content", T.BinaryType())]))
ASSIGNED = T.StructType([T.StructField("json", T.StringType()), T.StructField("problem", T.StringType())])


@F.pandas_udf(T.StringType())
def nfkd_fold(values: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition, combining marks dropped; null counts as empty."""
    return values.map(lambda v: _MARKS.sub("", unicodedata.normalize("NFKD", (v or "").lower())))


def norm_word(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else "".join(c for c in low if unicodedata.category(c)[0] in "LN")


def kept_tokens(left: list[str], right: list[str], most_bytes: int = ROWS_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of both sides are in their longest common subsequence of normalised words; tokens without letters and digits are in none.

    Of several such subsequences it is the one whose walk from the front passes over the right side's tokens first.
    """
    norms = {"": 0}
    return kept_ids(*([norms.setdefault(norm_word(w), len(norms)) for w in side] for side in (left, right)), most_bytes)


def kept_ids(a: list[int], b: list[int], most_bytes: int = ROWS_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """kept_tokens for numbers of normalised words, of which 0 is none.

    Time grows with the product of both lengths, a machine word for 30 tokens of the right side. Rows of the table beyond
    most_bytes are made twice, from every so many that are held.
    """
    n, m = len(a), len(b)
    places: dict[int, list[int]] = {}
    for j, word in enumerate(b):
        if word:
            places.setdefault(word, []).append(m - 1 - j)

    @lru_cache(max(1, most_bytes * 8 // (m + 8)))
    def mask(word: int) -> int:
        """The right side's places of a word, the last place as the lowest bit."""
        bits = bytearray(m // 8 + 1)
        for p in places[word]:
            bits[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(bits, "little")

    # a row has a bit for each place of the right side: 0 where the common subsequence of what follows is longer with that place than without
    every = (1 << m) - 1

    def above(row: int, word: int) -> int:
        hit = word in places and row & mask(word)
        return (row + hit | row - hit) & every if hit else row

    step = max(n, 1) if n * m <= most_bytes * 8 else isqrt(n) + 1
    held = {n: every}
    row = every
    for i in range(n - 1, step - 1, -1):
        row = above(row, a[i])
        if i % step == 0:
            held[i] = row
    in_left, in_right = np.zeros(n, bool), np.zeros(m, bool)
    left_over = m
    for start in range(0, n, step):
        end = min(start + step, n)
        rows = [held.pop(end)]
        for i in range(end - 1, start - 1, -1):
            rows.append(above(rows[-1], a[i]))
        for i in range(start, end):
            # the next place of the right side that the word is at, or that can't be passed over without loss
            stops = every ^ rows.pop() | (mask(a[i]) if a[i] in places else 0)
            left_over = (stops & ((1 << left_over) - 1)).bit_length()
            if not left_over:
                return in_left, in_right
            if b[m - left_over] == a[i]:
                in_left[i] = in_right[m - left_over] = True
                left_over -= 1
    return in_left, in_right


def _marked(tokens: pa.ListArray, kept: list[np.ndarray]) -> pa.ListArray:
    """Arrow's own columns of tokens and marks: no Python object stays for a token."""
    offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
    values = pa.StructArray.from_arrays([tokens.flatten(), pa.array(np.concatenate([np.zeros(0, bool), *kept]))], names=["token", "kept"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _numbered(tokens: pa.ListArray, norms: dict[str, int]):
    """Each row's tokens as numbers of their normalised words; a word that a batch repeats is a Python string once."""
    coded = tokens.flatten().dictionary_encode()
    flat = np.asarray([norms.setdefault(norm_word(w), len(norms)) for w in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
    ends = np.cumsum(tokens.value_lengths().to_numpy())
    return (flat[start:end].tolist() for start, end in zip([0, *ends], ends))


def _diff(left: pa.Array, right: pa.Array, most: int | None = None) -> pa.StructArray:
    sides, kept, cut = [], ([], []), np.zeros(len(left), bool)
    for side in (left, right):
        side = pc.fill_null(side, [])
        if most is not None:
            cut |= pc.greater(pc.list_value_length(side), most).to_numpy(zero_copy_only=False)
            side = pc.list_slice(side, 0, most)
        sides.append(side.cast(pa.list_(pa.string())))
    norms = {"": 0}
    for a, b in zip(*(_numbered(side, norms) for side in sides)):
        for out, marks in zip(kept, kept_ids(a, b)):
            out.append(marks)
    return pa.StructArray.from_arrays([_marked(sides[0], kept[0]), _marked(sides[1], kept[1]), pa.array(cut)], names=["left", "right", "cut"])


@F.arrow_udf(DIFF)
def _word_diff(left: pa.Array, right: pa.Array) -> pa.Array:
    return _diff(left, right, MOST_TOKENS)


@F.arrow_udf(DIFF)
def _whole_diff(left: pa.Array, right: pa.Array) -> pa.Array:
    return _diff(left, right)


def word_diff(left: Column, right: Column) -> Column:
    """kept_tokens for arrays of tokens, of which the first MOST_TOKENS count, and no more are handed over; cut says that a side has more."""
    return _word_diff(*(F.slice(F.col(c) if isinstance(c, str) else c, 1, MOST_TOKENS + 1) for c in (left, right)))


def whole_diff(left: Column, right: Column) -> Column:
    """kept_tokens for arrays of tokens, all of them; cut is false."""
    return _whole_diff(left, right)


_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", re.S)
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def unescaped(text: str) -> str:
    """A script string's content."""
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), text)


def assigned_value(page: str | None, name: str) -> str | None:
    """The JSON text that a page's script assigns to window.<name>: a string, or a balanced object or array.

    Braces inside strings don't count and escapes are honoured. Null where nothing is assigned; a value without an end is an error.
    """
    found = re.search(r"window\." + re.escape(name) + r"\s*=\s*", page or "")
    if not found:
        return None
    at = found.end()
    if at >= len(page):
        raise ValueError(f"no value is assigned to {name}")
    quote = page[at] if page[at] in "\"'`" else ""
    depth, inside, k = 0, "", at
    while k < len(page):
        c = page[k]
        if inside:
            if c == "\\":
                k += 1
            elif c == inside:
                inside = ""
                if quote:
                    text = page[at : k + 1]
                    return json.dumps(unescaped(text[1:-1]), ensure_ascii=False)
        elif c in "\"'`":
            inside = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return page[at : k + 1]
        elif not depth and c in ";\n<":
            return page[at:k].strip()
        k += 1
    raise ValueError(f"the value assigned to {name} has no end")


@F.pandas_udf(ASSIGNED)
def window_assignment(pages: pd.Series, names: pd.Series) -> pd.DataFrame:
    """assigned_value of each page, or what is wrong with it; no page fails the others."""
    rows = []
    for page, name in zip(pages, names):
        try:
            value = assigned_value(page, name)
            rows.append((value, f"nothing is assigned to {name}" if value is None else None))
        except ValueError as problem:
            rows.append((None, str(problem)))
    return pd.DataFrame(rows, columns=["json", "problem"])


@F.pandas_udf(T.BinaryType())
def gunzip(values: pd.Series) -> pd.Series:
    """Bytes that start as a gzip stream are unpacked, others stay."""
    return values.map(lambda v: gzip.decompress(v) if v is not None and bytes(v[:2]) == b"\x1f\x8b" else v)


@F.pandas_udf(T.BinaryType())
def gzipped(values: pd.Series) -> pd.Series:
    """Bytes packed with gzip, the same each time."""
    return values.map(lambda v: None if v is None else gzip.compress(v, mtime=0))


@F.arrow_udf(T.StringType())
def plain_lines(values: pa.Array) -> pa.Array:
    """HTML entities decoded, a byte order mark dropped, line ends made \\n. Texts become Python's TEXTS_AT_ONCE at a time, so that no batch is held as such."""
    one = lambda v: None if v is None else html.unescape(v).removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    parts = [pa.array([one(v.as_py()) for v in values.slice(k, TEXTS_AT_ONCE)], pa.string()) for k in range(0, len(values), TEXTS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.pandas_udf(MEMBERS)
def unzipped(values: pd.Series) -> pd.Series:
    """Files of zip archives, folders left out."""

    def one(data):
        if data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [{"member": i.filename, "content": z.read(i)} for i in z.infolist() if not i.is_dir()]

    return values.map(one)
