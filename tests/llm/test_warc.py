import gzip
import hashlib
from base64 import b32encode

from oracle import rows_of, rows_of_sql

from lacuna.llm import warc
from lacuna.llm.common import scratch


def test_equals_sql(spark, sf):
    assert rows_of(warc.op5_warc(spark, sf)) == rows_of_sql(warc.OP5_SQL, sf)


S = warc.SENTINEL
PAYLOADS = ["", "a", S, S + S, "x" + S + "y", "WARC/1.1", "\r\nWARC/1.1", "\r\n\r\nWARC/1.", "1" + S[:-1], "\r\n\r\n\r\n" + S + "\r\n", "\r\n\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1", "é" * 50, "\U0001f600\r" * 33, "end\r\n", "\n", "\r\n\r\n", "0123456789" * 20]


def test_round_trip_of_nasty_payloads(spark):
    rows = [(i, f"http://h/{i}\r\n\r\nWARC/1.1 x", p) for i, p in enumerate(PAYLOADS)] + [(50, None, None), (51, "u", "a"), (51, "u", "a"), (2, "u", S), (None, "u", "a"), (None, "u", "solo")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (4, 9, 1 << 16):
        path = scratch(spark, "t")
        warc.write_warc(df.repartition(3), path, chunk=chunk)
        out = warc.read_records(spark, path).collect()
        assert len(out) == len(rows) and all(r["sound"] for r in out)
        first = {}
        for i, _, p in rows:
            if i is not None:
                first[p or ""] = min(i, first.get(p or "", i))
        want = []
        for i, _, p in rows:
            p = p or ""
            f = first.get(p)
            revisit = f is not None and (i is None or f < i)
            want.append((i, len(p.encode()), b32encode(hashlib.sha1(p.encode()).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
        got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_archives_are_warc(spark):
    """A plain reader that trusts Content-Length alone finds the same records."""
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(PAYLOADS)], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(df, path, chunk=16)
    import pathlib

    payload = {}
    for f in sorted(pathlib.Path(path).glob("part-*")):
        data = gzip.open(f).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            block = rest[:n]
            assert rest[n : n + 4] == b"\r\n\r\n"
            if fields["WARC-Type"] != "continuation":
                block = block.partition(b"\r\n\r\n")[2]
            payload.setdefault(int(fields["Page-ID"]), {})[int(fields.get("WARC-Segment-Number", 1))] = block
            data = rest[n + 4 :]
    assert {i: b"".join(v for _, v in sorted(p.items())).decode() for i, p in payload.items()} == dict(enumerate(PAYLOADS))


def test_empty(spark):
    path = scratch(spark, "t")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(df, path, least=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_records(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_time_grows_in_proportion(tmp_path):
    """One forward pass: sixteen times the payload takes about sixteen times as long to cut, and every chunk is small."""
    import time

    def seconds(mb):
        data = memoryview((b"0123456789abcde\n" * 65536) * mb)
        began, n = time.perf_counter(), 0
        for s in warc.segments(1, "u", data, len(data), b"\0" * 20, None, warc.CHUNK, "d"):
            n += len(s)
            assert len(s) < warc.CHUNK + 2000
        assert n > len(data)
        return time.perf_counter() - began

    seconds(1)
    assert seconds(128) < 16 * 3 * max(seconds(8), 0.01)


def test_many_megabytes(spark):
    big = "0123456789é" * 3_000_000
    df = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", "x" + big)], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(df, path)
    assert warc.read_chunks(spark, path).agg({"chunk_no": "max"}).first()[0] >= len(big) // warc.CHUNK
    for r in warc.read_records(spark, path).collect():
        p = big if r["page_id"] < 3 else "x" + big
        assert r["sound"] and r["payload_bytes"] == len(p.encode()) and r["payload_digest"] == b32encode(hashlib.sha1(p.encode()).digest()).decode()
        assert r["record_type"] == ("revisit" if r["page_id"] == 2 else "response")


def test_damage_is_seen(spark, tmp_path):
    """A revisit whose response is missing or another one, a chunk that was altered: not sound."""
    df = spark.createDataFrame([(1, "u", "abc" * 9), (2, "u", "abc" * 9), (3, "u", "other"), (4, "u", "y" * 40)], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(df.coalesce(1), path, chunk=16, compression="none")
    rows = [r["value"] for r in spark.read.option("lineSep", warc.END + warc.VERSION).text(path).collect()]

    def sound(change):
        out = scratch(spark, "t")
        kept = [x for r in rows if (x := change(r)) is not None]
        body = [r.removeprefix(warc.VERSION).removesuffix(warc.END) for r in kept]
        spark.createDataFrame([(warc.VERSION + b,) for b in body], "value string").coalesce(1).write.option("lineSep", warc.END).text(out)
        return {r["page_id"]: r["sound"] for r in warc.read_records(spark, out).collect()}

    assert sound(lambda r: r) == {1: True, 2: True, 3: True, 4: True}
    assert sound(lambda r: None if "Page-ID: 1\r\n" in r else r) == {2: False, 3: True, 4: True}
    assert sound(lambda r: r.replace("Page-Refers-To: 1", "Page-Refers-To: 3")) == {1: True, 2: False, 3: True, 4: True}
    assert sound(lambda r: r.replace("yyy", "yzy")) == {1: True, 2: True, 3: True, 4: False}


def test_mistaken_by_the_bitmap(spark, monkeypatch):
    """With a bitmap of few bits most responses pass for revisits; the result stays."""
    from lacuna.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", 2)
    df = spark.createDataFrame([(i, "u", f"p{i % 40}") for i in range(60)] + [(None, "u", "p1")], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(df, path)
    out = warc.read_records(spark, path).collect()
    assert len(out) == 61 and all(r["sound"] for r in out)
    assert sorted(r["page_id"] for r in out if r["record_type"] == "response") == list(range(40))
