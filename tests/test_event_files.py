"""The sse data source: ranges of any size, growing files, writing again."""

import io
import random

import pytest
from pyspark.sql import functions as F

from maskloom.sources import event_files, sse

EVENT = ["event: a", "data: x", "data:  two", "data", ":note", "id: 7", "retry: 30", "retry: x", "é😀: q", "data: <A_1A>"]


def _body(rng):
    parts = []
    for _ in range(rng.randint(0, 12)):
        end = rng.choice(["\n", "\r\n"])
        parts.append(end.join(rng.choices(EVENT, k=rng.randint(1, 3))) + end)
        parts.append("".join(rng.choices(["\n", "\r\n"], k=rng.randint(1, 4))))
    body = "".join(parts)
    return rng.choice(["", "\n", "\r\n\n", "﻿"]) + (body if rng.random() < 0.5 else body.rstrip("\r\n"))


def _events(raw, size):
    return [x for k in range(0, len(raw), size) for x in event_files.raw_events(io.BytesIO(raw), k, min(k + size, len(raw)))]


def test_ranges_of_any_size_give_the_same_events():
    rng = random.Random(3)
    for _ in range(150):
        raw = _body(rng).encode()
        whole = _events(raw, max(len(raw), 1))
        for size in (1, 2, 3, 5, 17, 64):
            assert _events(raw, size) == whole, (raw, size)
        assert all(raw[at:].startswith(b"".join(lines)) for at, lines in whole)


def test_borders():
    for raw, want in [(b"", 0), (b"data: a\n", 0), (b"data: a\n\n", 9), (b"data: a\r\n\r\nda", 11), (b"a\n\nb\n\nc\n", 6)]:
        assert event_files.last_border(io.BytesIO(raw), 0, len(raw)) == want
    for n in (event_files.BLOCK - 1, event_files.BLOCK, event_files.BLOCK + 1):  # cut by a block's begin
        assert event_files.last_border(io.BytesIO(b"a\r\n\r\n" + b"x" * n), 0, n + 5) == 5


def test_read_as_parsed(spark, tmp_path):
    event_files.register(spark)
    rng = random.Random(4)
    bodies = [_body(rng).lstrip("\n\r﻿") for _ in range(12)]
    for k, b in enumerate(bodies):
        (tmp_path / f"{k:02}.sse").write_bytes(b.encode())
    (tmp_path / "_hidden").write_text("data: no\n\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "12.sse").write_text("data: deep\n\n")
    rows = spark.createDataFrame(list(enumerate([*bodies, "data: deep\n\n"])), "k int, body string")
    want = sorted((r.k, r.data) for r in sse.parse_events(rows, "body").collect())
    for split in ("31", "1000000"):
        got = spark.read.format("sse").option("splitBytes", split).load(str(tmp_path))
        k = F.regexp_extract("file", r"(\d+)\.sse$", 1).cast("int").alias("k")
        assert sorted((r.k, r.data) for r in got.select(k, "data").collect()) == want, split
    one = spark.read.format("sse").load(str(tmp_path / "deep" / "12.sse")).collect()
    assert [(r.at, r.event, r.id, r.retry, r.data) for r in one] == [(0, None, None, None, "deep")]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("sse").load(str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="not-there"):
        spark.read.format("sse").load(str(tmp_path / "not-there")).collect()


def test_written_is_read(spark, tmp_path):
    event_files.register(spark)
    rows = [("a\nb", "i\r", 5, "x\r\ny\n"), (None, None, None, None), ("", "", -3, "é😀"), (None, "2", None, " led by a space")]
    df = spark.createDataFrame(rows, "event string, id string, retry long, data string").withColumn("more", F.lit(1)).repartition(3)
    path = str(tmp_path / "out")
    df.write.format("sse").mode("append").save(path)
    columns = ["event", "id", "retry", "data"]
    read = lambda: sorted(map(tuple, spark.read.format("sse").load(path).select(columns).collect()), key=str)
    want = sorted([("ab", "i", 5, "x\ny\n"), (None, None, None, ""), ("", "", 0, "é😀"), (None, "2", None, " led by a space")], key=str)
    assert read() == want
    df.write.format("sse").mode("append").save(path)
    assert read() == sorted(want * 2, key=str)
    (tmp_path / "out" / "part-of-a-lost-task.sse").write_text("data: lost\n\n")
    assert read() == sorted(want * 2, key=str)
    df.filter("id = '2'").write.format("sse").mode("overwrite").save(path)
    assert read() == [(None, "2", None, " led by a space")]


def test_a_batch_counts_once(tmp_path):
    path, folder = str(tmp_path), event_files._Folder(str(tmp_path))
    for text in ("first", "again"):
        out = event_files._StreamWriter(path, "q")
        (tmp_path / f"part-{text}.sse").write_text(f"data: {text}\n\n")
        out.commit([event_files.Written(f"part-{text}.sse"), None, event_files.Written(None)], 0)
    assert [f.rsplit("/", 1)[1] for f in folder.sizes()] == ["part-first.sse"] and not (tmp_path / "part-again.sse").exists()


def test_stream_of_a_growing_file(spark, tmp_path):
    """Run, append, run again from the checkpoint: each whole event comes once."""
    event_files.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        rows = spark.readStream.format("sse").option("splitBytes", "9").load(str(source))
        q = rows.writeStream.format("sse").option("query", "q").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(r.data for r in spark.read.format("sse").load(out).collect())

    (source / "a").write_text("data: 1\n\ndata: 2\n\ndata: 3 beg")
    assert run() == ["1", "2"]
    with (source / "a").open("a") as f:
        f.write("ins\n\ndata: 4\n\n")
    (source / "b").write_text("data: 5\r\n\r\n")
    assert run() == ["1", "2", "3 begins", "4", "5"]
    assert run() == ["1", "2", "3 begins", "4", "5"]
