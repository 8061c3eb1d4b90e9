"""Keyed tables that rewrite the touched buckets, and event lines over pieces cut anywhere."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.events import events, lines
from lodestrata.sources import keyed
from lodestrata.sources.keyed import Conflict, KeyedTable

SCHEMA = "k long, name string, n int"


def rows(spark, *made):
    return spark.createDataFrame(list(made), SCHEMA)


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_changes_rewrite_the_buckets_of_their_keys(spark, tmp_path):
    stored = spark.range(1_000).select(F.col("id").alias("k"), F.format_string("name %d", "id").alias("name"), F.lit(1).alias("n"))
    table = KeyedTable.create(stored, str(tmp_path / "t"), ["k"], "n", 32)
    before, files = table.folders(), {f: open(f, "rb").read() for f in glob.glob(f"{table.path}/data/**/*.parquet", recursive=True)}
    assert len(before) == 32 and table.read().count() == 1_000
    new = rows(spark, (5, None, 2), (6, "old", 0), (2_000, "new", 1))
    written = table.upsert(new)
    after = table.folders()
    theirs = {r[0] for r in new.select(F.pmod(F.xxhash64("k"), F.lit(32)).cast("int")).collect()}
    assert {b for b in after if after[b] != before[b]} == theirs and written == len(theirs)
    assert all(open(f, "rb").read() == b for f, b in files.items())
    got = {r.k: (r.name, r.n) for r in table.read().collect()}
    assert got[5] == (None, 2) and got[6] == ("name 6", 1) and got[2_000] == ("new", 1) and len(got) == 1_001  # a null is kept, an older row is not
    assert sorted(r.k for r in table.get(spark.createDataFrame([(5,), (7,), (9_999,)], "k long")).collect()) == [5, 7]
    assert table.delete(spark.createDataFrame([(5,), (5,), (9_999,)], "k long")) <= 2
    assert table.read().filter("k = 5").count() == 0 and table.read().count() == 1_000
    assert KeyedTable(spark, table.path).read().count() == 1_000


def test_repeated_null_and_several_keys(spark, tmp_path):
    table = KeyedTable.create(rows(spark, (1, "a", 1), (1, "b", 2), (None, "c", 1)), str(tmp_path / "t"), ["k"], "n")
    assert content(table) == [(1, "b", 2), (None, "c", 1)]
    table.upsert(rows(spark, (None, "d", 1), (1, "x", 3), (1, "y", 4)))
    assert content(table) == [(1, "y", 4), (None, "d", 1)]
    two = KeyedTable.create(rows(spark, (1, "a", 1), (1, "b", 1)), str(tmp_path / "u"), ["k", "name"], "n")
    two.upsert(rows(spark, (1, "a", 2)))
    assert content(two) == [(1, "a", 2), (1, "b", 1)]


def test_empty_tables(spark, tmp_path):
    table = KeyedTable.create(rows(spark), str(tmp_path / "t"), ["k"], "n")
    assert content(table) == [] and table.upsert(rows(spark)) == 0 and table.delete(spark.createDataFrame([(1,)], "k long")) == 0
    table.upsert(rows(spark, (1, "a", 1)))
    assert content(table) == [(1, "a", 1)]
    table.delete(spark.createDataFrame([(1,)], "k long"))
    assert content(table) == [] and content(KeyedTable(spark, table.path)) == []
    with pytest.raises(ValueError, match="no table"):
        KeyedTable(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="already"):
        KeyedTable.create(rows(spark), table.path, ["k"], "n")


def test_a_broken_change_is_not_seen_and_the_second_of_two_fails(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(rows(spark, *[(i, "a", 1) for i in range(50)]), str(tmp_path / "t"), ["k"], "n")
    first = content(table)
    with pytest.raises(Exception, match="broken"):
        table.upsert(rows(spark, (1, "z", 9)).withColumn("n", F.when(F.col("k") == 1, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n"))))
    assert content(table) == first

    real = keyed.KeyedTable._manifests
    other = KeyedTable(spark, table.path)

    def meanwhile(self):
        monkeypatch.setattr(keyed.KeyedTable, "_manifests", real)
        known = real(self)
        # Another writer began from the same manifest and has written the next one.
        line = [(*self._about, b, f) for b, f in self._folders.items()]
        spark.createDataFrame(line, keyed.MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/n={max(n for n, _ in known) + 1}/id=0")
        return known

    monkeypatch.setattr(keyed.KeyedTable, "_manifests", meanwhile)
    with pytest.raises(Conflict):
        other.upsert(rows(spark, (1, "late", 5)))
    assert content(table) == first


def stream(body, size):
    return [body[i : i + size] for i in range(0, len(body), size)]


BODY = 'data: {"type": "token", "content": "naïve 漢字 🎉"}\r\n\n: comment\ndata:{"type":"done"}\n  data: [1]  \ndata: {"broken\ndata:\nevent: x\ndata: "text"\ndata: {"content": "no type"}\ndata: {"type": "open'


def by_hand(body):
    out = []
    for line in body.split("\n")[:-1]:
        line = line.strip()
        if line.startswith("data:"):
            try:
                found = json.loads(line[5:].strip() or "x")
            except ValueError:
                continue
            if isinstance(found, dict):
                out.append((found.get("type"), found.get("content")))
    return out


def test_pieces_cut_at_every_offset_give_the_lines_of_the_whole(spark):
    raw = BODY.encode()
    rows = [(f"two {at}", i, p) for at in range(len(raw) + 1) for i, p in enumerate((raw[:at], raw[at:]))]
    rows += [(f"every {size}", i * 3, p) for size in (1, 2, 7, 50) for i, p in enumerate(stream(raw, size))]
    rows += [(None, 1, b"data: {}\n"), (None, 0, None), ("none", 0, None), ("empty", 0, b"")]
    random.Random(1).shuffle(rows)
    pieces = spark.createDataFrame(rows, "stream string, seq long, body binary").repartition(3)
    got = {}
    for r in lines(pieces).collect():
        got.setdefault(r.stream, {})[r.line_no] = r.line
    want = BODY.split("\n")[:-1]
    for name, own in got.items():
        assert [own[i] for i in range(len(own))] == (want if name else ["data: {}"])
    assert len(got) == len(raw) + 1 + 4 + 1
    read = events(lines(pieces.filter("stream like 'every%'")), "type string, content string")
    found = {}
    for r in read.collect():
        found.setdefault(r.stream, []).append((r.line_no, r.event.type, r.event.content))
    assert all([(t, c) for _, t, c in sorted(v)] == by_hand(BODY) for v in found.values()) and len(found) == 4


def test_long_lines_and_many_pieces(spark, monkeypatch):
    from lodestrata.operators import events as module

    monkeypatch.setattr(module, "RUN", 16)
    long = 'data: {"type": "token", "content": "' + "x" * 200_000 + '"}\n'
    pieces = stream((long + "data: {\"type\": \"b\"}\n" * 300).encode(), 997)
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(pieces)], "stream string, seq long, body binary").repartition(4)
    got = events(lines(df), "type string, content string").collect()
    assert len(got) == 301 and max(len(r.event.content or "") for r in got) == 200_000
    text = spark.createDataFrame([("s", 0, "a\nb"), ("s", 1, "c\n")], "stream string, seq long, body string")
    assert sorted((r.line_no, r.line) for r in lines(text).collect()) == [(0, "a"), (1, "bc")]
    assert lines(text.limit(0)).count() == 0
