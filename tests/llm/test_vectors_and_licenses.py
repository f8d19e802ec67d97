"""Whitening, hard negatives and license scans against brute force, and on hard rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import hard_negatives, license_scan, whitening
from lexiquarry.llm.license_rules import RULES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def sf_vectors(spark):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def brute_whitening(x, components):
    n = len(x)
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return (centred @ v[:, :components]) / np.sqrt(e[:components]), e / e.sum()


def test_whitening_query(spark):
    rows = sf_vectors(spark)
    x = np.floor(64 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64) + 1_000_000
    got = whitening.op11_whitening(spark, SF).collect()
    n, ids = len(rows), {i: k for k, (i, _, _) in enumerate(rows)}
    white, explained = brute_whitening(x.astype(np.float64), 32)
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    mine = np.zeros((n, 32))
    for r in got:
        mine[ids[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == int(((n * x[ids[r["vec_id"]]] - x.sum(axis=0)) ** 2).sum())
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    for k in range(32):  # either sign, the same for all rows
        assert min(np.abs(mine[:, k] - white[:, k]).max(), np.abs(mine[:, k] + white[:, k]).max()) < 1e-6
    own = mine - mine.mean(axis=0)
    error = np.abs(own.T @ own / n - np.eye(32)).max()
    assert {r["identity_error"] for r in got} and all(abs(r["identity_error"] - error) < 1e-9 and r["identity_error"] < 1e-4 for r in got)


def test_whitening_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [1.0, nan], 0), (4, [-inf, 0.0], 0), (9, [3e38, 0.0], 0)]
    flat = [(k, [float((k or 0) % 3), 5.0], 0) for k in (10, 11, 12, None)] + [(10, [1.0, 5.0], 0)]
    single, none = [(20, [1.0, 2.0, 3.0], None)], [(30, [], 1)]
    frame = spark.createDataFrame(bad + flat + single + none, VECTORS).selectExpr("*", "1 AS n", "2 AS x", "3 AS whitened")
    got = whitening.whiten(frame, 4).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["10", "10", "11", "12", "20", "None"]
    for r in got:
        if r["vec_id"] == 20:
            assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, [], [None] * 3, 0.0)
        else:
            assert r["n"] == 5 and len(r["whitened"]) == 1 and r["explained"] == [1.0, 0.0] and r["identity_error"] < 1e-9
    assert whitening.whiten(frame.limit(0)).count() == 0
    huge = [(k, [float(2**40 * k), float(k * k)], 0) for k in range(4)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in huge]
    sums = [sum(c) for c in zip(*x)]
    want = {k: sum((4 * c - s) ** 2 for c, s in zip(x[k], sums)) for k in range(4)}
    assert max(want.values()) > 2**63
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(huge, VECTORS)).collect()} == want


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    first = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            row = (label, tuple(math.floor(scale * float(np.float32(c))) for c in v))
            first[i] = min(first.get(i, row), row)
    out = set()
    for a, (label, v) in first.items():
        if a % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(v, w)), i, l == label) for i, (l, w) in first.items() if i != a and len(w) == len(v))
            for s, p, _ in [r for r in scored if r[2]][:positives]:
                fits = [r for r in scored if not r[2] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
                out |= {(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)}
    return out


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS cluster", "2 AS x", "3 AS n", "4 AS part")
    got = hard_negatives.mine(frame, F.col("vec_id") % 50 == 0, **options).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_hard_negatives(spark, monkeypatch):
    """Several lists, cells, blocks and rounds; copies, ties and a hot cluster."""
    monkeypatch.setattr(hard_negatives, "CELL", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "FIRST", 1)
    monkeypatch.setattr(hard_negatives, "GROWTH", 2)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 6))
    x = middle[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 6))
    x[:300] = middle[0] + 0.01 * rng.normal(size=(300, 6))
    x[300:340] = x[300]
    rows = [(i * 5, x[i].astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    want = brute_negatives(rows)
    assert len(want) > 200 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=4, low=10, high=99) == brute_negatives(rows, 2, 4, 10, 99)


def test_hard_negatives_of_hard_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 0), (3, [0.8, 0.0], 0), (3, [0.8, 0.0], 0), (4, [0.9, 0.1], 2), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 2), (7, [-1.0, 0.0], 1), (8, [-0.9, 0.0], 2), (50, [1.0], 1), (100, [], 1), (150, [0.0, 0.0], 2)]
    rows += [(None, [1.0, 0.0], 1), (9, None, 1), (10, [1.0, 0.0], None), (11, [1.0, None], 1), (12, [nan, 0.0], 1), (13, [float("inf"), 0.0], 2), (14, [3e38, 0.0], 2)]
    want = brute_negatives([r for r in rows if r[0] != 14])
    assert mined(spark, rows) == want and {r[2] for r in want} == {1, 2, 3}
    assert mined(spark, rows[:1]) == set() and hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0
    large = [(i, [2.0**17 * (i % 7 + 1), 2.0**16 * (i % 5)], i % 3) for i in range(60)]  # products beyond 2**53
    assert mined(spark, large) == brute_negatives(large) != set()


def brute_scan(text, rules):
    """Base phrases by words, and every rule at every place, by definition."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    found = []
    for label, weight, keywords, pattern in rules:
        if set(keywords.split()) <= set(words):
            whole, k = re.compile(pattern), 0
            while k < len(words):
                line = " ".join(words[k:])
                m = next((m for m in [re.match(f"(?:{pattern})(?= |$)", line)] if m), None)
                if m and whole.fullmatch(m.group()):
                    size = len(m.group().split())
                    found.append((k, k + size - 1, label, float(weight)))
                    k += size
                else:
                    k += 1
    kept = []
    for f in found:
        if not any(e[0] <= f[0] and f[1] <= e[1] for e in kept):
            kept.append(f)
    starts, base = [k for k, _ in places], sorted({x for _, x in places})
    labels = sorted({*base, *(f[2] for f in kept)})
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), max((f[3] for f in kept), default=0.0)), sorted(f[:3] for f in kept)


FORMS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: GPL-2.0-or-later", "Copyright (c) 2020 Foo Bar Inc. All rights reserved.", "© 2019 wir · Alle Rechte vorbehalten", "GNU Lesser General Public License version 2.1 or later",
    "GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "CC-BY-SA 4.0, CC BY-NC-ND 3.0 and cc by cc by", "https://creativecommons.org/licenses/by-nc/4.0/", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "dual-licensed under the MIT license and the BSD 3-Clause License", "ALL RIGHTS RESERVED ALL RIGHTS RESERVED", "cc by", "ccc by cc byx", "das Haus mit 0 Garten", "general\n\npublic\tlicense", "Mozilla Public License, v. 2.0", "MPL 2.0 mpl 1.1 epl", "tous droits réservés", "cc by " * 3000,
]


def test_license_scan(spark):
    rules = [line.split("|", 3) for line in RULES.strip().splitlines()]
    assert len(rules) > 200 and all(set(k.split()) for _, _, k, _ in rules)
    texts = FORMS[:-1] + [" x ".join(FORMS[:-1]), " ".join(FORMS[:-1][::-1]), "", " \n", None, "İ K"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    frame = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, words int, labels string")
    got = {r["doc_id"]: r for r in license_scan.scanned(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i if i else None]
        want, matches = brute_scan(t, rules)
        assert tuple(r)[1:8] == want, t
        assert sorted((m["first"], m["last"], m["label"]) for m in r["matches"]) == matches, t
    long = license_scan.scanned(spark.createDataFrame([(1, FORMS[-1] * 20)], "doc_id long, text string")).first()
    assert (long["words"], long["base"], long["first"], long["last"], long["labels"]) == (120_000, 60_000, 0, 119_998, "cc-by")
    assert license_scan.scanned(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text, label", [("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("gnu gpl", "gpl-any")])
def test_license_labels(text, label):
    assert label in license_scan.scanner(RULES).scan(text.encode())["labels"].split(",")


def test_license_query(spark):
    rules = [line.split("|", 3) for line in RULES.strip().splitlines()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = license_scan.op13_license_scan(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: brute_scan(t, rules)[0] for i, t in texts.items()} and len(got) == len(texts)
