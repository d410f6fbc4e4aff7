"""WARC archives and tool-call linking on small cases."""

import base64
import hashlib
import json

import pytest

from haulmark.llm.chat import Field, link_tool_calls, topological_depth
from haulmark.llm.warc import ArchiveReader, archive_round_trip, read_archives, write_archives
from haulmark.session import scratch_path

NASTY = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nx\r\n"
PAGES = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (2, "u\r\nWARC-Type: x", NASTY), (7, "u", None), (8, "u", ""), (None, "u", "null key"),
         (None, "u", "same"), (9, "u", "é퟿🙂" * 40), (11, "u", "\r\n"), (12, "u", "0" * 5000), (4, "u", "twin"), (4, "u", "twin"), (-6, "u", "minus")]


def plain(pages, least):
    first = {}
    for key, _, html in pages:
        data = (html or "").encode()
        first[data] = max((k for k in (first.get(data), key) if k is not None), default=None)
    out = []
    for key, _, html in pages:
        data = (html or "").encode()
        visit = len(data) >= least and key != first[data]
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if visit else "response", first[data] if visit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 20), (0, 7), (5, 64)])
def test_archives_give_back_every_page(spark, least, chunk):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    assert sorted(map(tuple, archive_round_trip(pages, least, chunk).collect()), key=str) == plain(PAGES, least)


def test_archives_of_nothing(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chunk_rows_carry_running_digests(spark):
    path, payload = scratch_path(spark, "test-warc"), bytes(range(256)) * 5
    write_archives(spark.createDataFrame([(1, "u", bytearray(payload))], "key long, uri string, payload binary"), path, chunk=100)
    rows = read_archives(spark, path).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == list(range(13)) and b"".join(r.data for r in rows) == payload
    for k, r in enumerate(rows):
        so_far = payload[:100 * (k + 1)]
        assert r.bytes_so_far == len(so_far) and r.digest_so_far == base64.b32encode(hashlib.sha1(so_far).digest()).decode() and r.last == (k == 12)


def record(kind, name, data, **more):
    digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": len(data), "Content-Length": len(data)} | more
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items())).encode() + b"\r\n" + data


def test_reader_refuses_damage():
    whole = record("response", "<a>", b"data")
    reader = ArchiveReader()
    assert [r["data"] for part in whole.split(b"\r\n\r\n") for r in reader.feed(part)] == [b"data"]
    reader.close()
    with pytest.raises(ValueError, match="digest"):
        list(ArchiveReader().feed(whole.replace(b"data", b"dat4")))
    with pytest.raises(ValueError, match="no WARC record"):
        list(ArchiveReader().feed(b"junk"))
    with pytest.raises(ValueError, match="origin"):
        list(ArchiveReader().feed(record("continuation", "<a:1>", b"x")))
    cut = ArchiveReader()
    list(cut.feed(whole[:-6]))
    with pytest.raises(ValueError, match="inside a record"):
        cut.close()


TOOLS = {"f": [Field("a", "integer"), Field("b", "string", False, ("x", "y")), Field("o", "object", False)]}
CALLS = "conv_id long, call_id string, name string, arguments string, parent_id string"


def linked(spark, calls, results):
    found = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, content string"), TOOLS)
    assert found.columns == ["conv_id", "call_id", "depth", "has_result", "errors", "json"]
    return {(r.conv_id, r.call_id): r for r in found.collect()}


def test_tool_calls(spark):
    rows = linked(spark, [
        (1, "c1", "f", '{"b": "x", "a": 1, "o": {"z": 1, "y": [true, null]}}', None), (1, "c2", "f", '{"a": "1"}', "c1"), (1, "c3", "f", '{"b": "q", "k": 0}', "c2"),
        (1, "c4", "g", "{}", "gone"), (1, "c5", "f", "not json", "c3"), (1, "c6", "f", "[1]", None), (1, "c7", None, None, None),
        (2, "c1", "f", '{"a": 1}', "c2"), (2, "c2", "f", '{"a": 1}', "c1"), (2, "c3", "f", '{"a": 1.5}', "c2"), (2, "c4", "f", '{"a": 1, "b": null}', "c4"),
        (None, "c1", "f", '{"a": 1}', None), (1, None, "f", "{}", None), (1, "c1", "f", '{"b": "x", "a": 1, "o": {"z": 1, "y": [true, null]}}', None),
    ], [(1, "c1", "done"), (1, "c1", "done later"), (1, "c2", None), (None, "c1", "n"), (3, "c1", "orphan"), (1, None, "lost")])
    assert rows[1, "c1"].json == '{"arguments":{"a":1,"b":"x","o":{"y":[true,null],"z":1}},"id":"c1","name":"f","result":"done"}'
    assert {k[1]: (r.depth, r.errors) for k, r in rows.items() if k[0] == 1} == {
        "c1": (0, ""), "c2": (1, "a is no integer"), "c3": (2, "missing a; b is not allowed; unknown k; no result"), "c4": (0, "unknown tool; unknown parent; no result"),
        "c5": (3, "malformed; no result"), "c6": (0, "malformed; no result"), "c7": (0, "malformed; no result")}
    assert {k[1]: (r.depth, r.errors) for k, r in rows.items() if k[0] == 2} == {
        "c1": (None, "cycle; no result"), "c2": (None, "cycle; no result"), "c3": (None, "a is no integer; cycle; no result"), "c4": (None, "b is no string; cycle; no result")}
    assert rows[None, "c1"].has_result and rows[None, "c1"].errors == ""
    assert (rows[3, "c1"].errors, rows[3, "c1"].json) == ("no call", '{"id":"c1","result":"orphan"}')
    assert all(json.loads(r.json) for r in rows.values()) and len(rows) == 13


def test_long_chain_takes_its_order(spark):
    chain = spark.range(300).selectExpr("1L AS conv_id", "CAST(id AS STRING) AS call_id", "CASE WHEN id > 0 THEN CAST(id - 1 AS STRING) END AS parent_id")
    assert {int(r.call_id): r.depth for r in topological_depth(chain).collect()} == {k: k for k in range(300)}


def test_no_calls(spark):
    assert linked(spark, [], []) == {}
