"""The archive source in batch and as a stream."""

import os
import zipfile

from lexiquarry.sources import archives


def made(path, members):
    with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    os.rename(f"{path}.part", path)


def rows(frame):
    return sorted((r["archive"], r["member"], r["line_no"], r["line"]) for r in frame.filter("problem IS NULL").collect())


def test_batch(spark, tmp_path, monkeypatch):
    spark.dataSource.register(archives.ArchiveLines)
    (tmp_path / "in").mkdir()
    long = "x" * (3 << 20)  # a line over several chunks, cut within a character
    made(tmp_path / "a.zip", {"one.txt": "﻿a\r\nb\n\nc", "deep/two.txt": "é" * 9 + "\n", "none.txt": "", "three.md": "m", "folder/": ""})
    made(tmp_path / "in" / "b.zip", {"one.txt": long + "é\n" + long, "many.txt": "\n".join(map(str, range(25_000)))})
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    frame = spark.read.format("archive_lines").option("glob", "*.txt").load(str(tmp_path))
    got = rows(frame)
    want = [("a.zip", "deep/two.txt", 0, "é" * 9), *(("a.zip", "one.txt", k, t) for k, t in enumerate(["a", "b", "", "c"])), ("b.zip", "one.txt", 0, long + "é"), ("b.zip", "one.txt", 1, long), *(("b.zip", "many.txt", k, str(k)) for k in range(25_000))]
    assert got == sorted(want)
    assert [(r["archive"], r["member"]) for r in frame.filter("problem IS NOT NULL").collect()] == [("broken.zip", None)]
    assert frame.rdd.getNumPartitions() == 6  # five members and the broken archive
    assert rows(spark.read.format("archive_lines").load(f"file://{tmp_path}/a.zip").filter("member = 'three.md'")) == [("a.zip", "three.md", 0, "m")]


def test_damaged_member(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveLines)
    made(tmp_path / "a.zip", {"one.txt": "".join(f"{k * 7919 % 10007}\n" for k in range(60_000)), "two.txt": "fine"})
    data = bytearray((tmp_path / "a.zip").read_bytes())
    at = len(data) // 2
    data[at : at + 200] = b"\0" * 200
    (tmp_path / "a.zip").write_bytes(bytes(data))
    frame = spark.read.format("archive_lines").load(str(tmp_path))
    assert [r["member"] for r in frame.filter("problem IS NOT NULL").collect()] == ["one.txt"]
    assert frame.filter("member = 'two.txt'").first()["line"] == "fine"


def test_stream(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveLines)
    source = tmp_path / "in"
    source.mkdir()
    made(source / "z.zip", {"one.txt": "a\nb"})
    stream = spark.readStream.format("archive_lines").load(str(source))
    query = stream.writeStream.format("memory").queryName("archive").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        first = rows(spark.table("archive"))
        made(source / "a.zip", {"one.txt": "c"})
        query.processAllAvailable()
    finally:
        query.stop()
    assert first == [("z.zip", "one.txt", 0, "a"), ("z.zip", "one.txt", 1, "b")]
    assert rows(spark.table("archive")) == sorted([*first, ("a.zip", "one.txt", 0, "c")])
