import collections
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tool_calls, warc

PAGES = "page_id long, url string, html string, digest string, refers_to long"


def page_rows():
    big = "<p>same</p>" * 200
    return [
        (1, "http://a.example/x?q=ü b", big, "d", 1), (2, None, big, None, None), (5, "http://a.example/\r\nWARC-Type: x", big, None, None), (5, "u", big, None, None),
        (3, "u", "<p>short</p>", None, None), (4, "v", "<p>short</p>", None, None), (6, "w", None, None, None), (7, "w", "", None, None),
        (None, "n", big, None, None), (8, "x", "é" * 600 + "\r\n\r\n" + "z" * 200_000, None, None), (9, "x", "a" * 1000, None, None), (10, "x", "a" * 1000, None, None),
    ]


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    largest = collections.defaultdict(int)
    for page_id, _, html, *_ in rows:
        largest[html] = max(largest[html], page_id or 0)
    want = collections.Counter()
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and page_id is not None and largest[html] != page_id
        want[(page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_selected_records_by_index(spark):
    rows = page_rows()
    index = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), warc.shared_folder(spark, "warc-test"))
    assert index.select("file").distinct().count() == 1
    places = sorted((r["offset"], r["length"]) for r in index.collect())
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    picked = index.where("page_id in (8, 3)")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(picked, payloads=True).collect()}
    assert got == {i: h for i, _, h, *_ in rows if i in (8, 3)}


def test_records_are_gzip_members(spark, monkeypatch):
    """Any WARC reader can read an archive as a whole, and the number of read tasks follows the bytes."""
    rows = page_rows()
    index = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), warc.shared_folder(spark, "warc-test")).orderBy("offset").collect()
    data = open(index[0]["file"].removeprefix("file:"), "rb").read()
    parts = [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in index]
    assert gzip.decompress(data) == b"".join(parts) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
    frame = spark.createDataFrame(index)
    assert warc.read(frame, stretch=max(1, len(data) // 5)).rdd.getNumPartitions() >= 5


def test_reads_are_coalesced():
    ranges = [(0, 10), (10, 5), (100, 10), (111, 4), (1000, 50), (1050, 5000)]
    reads = warc.coalesced(ranges, gap=10, stretch=1000)
    assert [(a, b) for a, b, *_ in reads] == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert all(offset == ranges[a][0] and offset + length == sum(ranges[b - 1]) for a, b, offset, length in reads)
    assert warc.coalesced([], 1, 1) == []


def test_a_damaged_payload_is_an_error():
    data = warc.record(3, "u", b"payload", None)
    assert warc.parse(data)[:5] == (3, 7, hashlib.sha1(b"payload").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"\r\n\r\npayload", b"\r\n\r\npaylowd"))
    assert warc.parse(warc.record(3, "u", b"payload", 9))[:5] == (3, 7, hashlib.sha1(b"payload").hexdigest(), "revisit", 9)


CALLS = "conv_id long, pos long, call_id string, name string, arguments string, needs array<string>, status string"
RESULTS = "conv_id long, pos long, call_id string, content string, pos_ long"
SCHEMA = '{"type":"object","required":["n"],"additionalProperties":false,"properties":{"n":{"type":"integer","minimum":1},"s":{"enum":["a",1]},"l":{"items":{"type":"string","maxLength":2}}}}'


def formatted(spark, calls, results):
    frames = spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, 0) for r in results], RESULTS)
    return tool_calls.formatted(*frames, spark.createDataFrame([("t", SCHEMA), ("t", SCHEMA)], "name string, schema string")).collect()


def test_calls_are_linked_and_ordered(spark):
    calls = [
        (1, 1, "a", "t", '{"n": 1}', None), (1, 2, "b", "t", '{"n": 2.0, "s": 1.0}', ["c", "nobody", None]), (1, 3, "c", "t", '{"l": ["abc"], "q": 1}', ["c"]),
        (1, 9, "a", "t", '{"n": 5}', None), (1, 4, None, "t", "{}", None), (2, 1, "a", "u", "{", []), (None, 1, "a", "u", None, None),
        (3, 1, "x", "t", '{"n": 1}', ["y"]), (3, 2, "y", "t", '{"n": 1}', ["x"]), (3, 3, "z", "t", '{"n": 1}', ["y"]),
    ]
    results = [
        (1, 5, "a", "ra"), (1, 6, "c", "rc"), (1, 7, "b", "rb"), (1, 8, "b", "again"), (2, 4, "lost", None), (None, 3, "a", None), (1, 5, None, "none"),
        (3, 4, "x", "rx"), (3, 5, "y", "ry"),
    ]
    rows = formatted(spark, calls, results)
    status = collections.Counter((r["conv_id"], r["call_id"], r["status"]) for r in rows)
    assert status == collections.Counter([
        (1, "a", "linked"), (1, "b", "linked"), (1, "c", "linked"), (1, "a", "repeated_call"), (1, None, "no_id"), (1, "b", "repeated_result"), (1, None, "no_id"),
        (2, "a", "no_result"), (2, "lost", "no_call"), (None, "a", "linked"), (3, "x", "linked"), (3, "y", "cycle"), (3, "z", "no_result"),
    ])
    by = {(r["conv_id"], r["call_id"]): r for r in rows if r["status"] in ("linked", "no_result", "cycle")}
    place = {k: (r["order_pos"], r["order_depth"]) for k, r in by.items()}
    assert place[(1, "a")] == (1, 0) and place[(1, "c")] == (3, 0)
    assert place[(1, "b")] > (6, 0)  # after the result of c, which is at 6
    assert by[(1, "b")]["valid"] and by[(1, "b")]["message"] == '{"arguments":{"n":2,"s":1},"id":"b","name":"t","result":"rb"}'
    assert by[(1, "c")]["errors"] == ["$.n: required", "$.l[0]: maxLength", "$.q: additionalProperties"]
    assert by[(2, "a")]["errors"] == ["invalid_json"] and by[(None, "a")]["errors"] == ["invalid_json"]
    assert place[(3, "y")] == (2, 0) and place[(3, "x")] > (5, 0)
    assert formatted(spark, [], []) == []


def test_order_against_dependencies(spark):
    """Every needed result comes before the call, whatever the positions."""
    rng = random.Random(4)
    calls, results = [], []
    for conv in range(6):
        order = [f"c{i}" for i in range(15)]
        rng.shuffle(order)
        for i, name in enumerate(order):
            calls.append((conv, rng.randint(0, 40), name, "t", '{"n": 1}', rng.sample(order[:i], min(i, rng.randint(0, 3)))))
            results.append((conv, rng.randint(0, 60), name, "r"))
    place = {(r["conv_id"], r["call_id"]): (r["order_pos"], r["order_depth"]) for r in formatted(spark, calls, results)}
    pos = {(r[0], r[2]): r[1] for r in results}
    for conv, at, name, _, _, needs in calls:
        own = place[(conv, name)]
        assert own >= (at, 0)
        for other in needs:
            p, d = place[(conv, other)]
            assert own > max((pos[(conv, other)], 0), (p, d + 1))


def test_repeated_ids_are_not_multiplied(spark):
    calls = [(1, i, "same", "t", '{"n": 1}', None) for i in range(300)]
    results = [(1, 1000 + i, "same", "r") for i in range(300)]
    assert collections.Counter(r["status"] for r in formatted(spark, calls, results)) == {"linked": 1, "repeated_call": 299, "repeated_result": 299}


def test_canonical_json():
    text = '{"b": [1.0, 1e21, 1.5e-7, 0.000001, -0.0, 12345678901234567890], "a": "\\u00e9\\n\\"", "\\ud83d\\ude00": null, "\\ufb33": true}'
    assert tool_calls.canonical(json.loads(text)) == '{"a":"é\\n\\"","b":[1,1e+21,1.5e-7,0.000001,0,12345678901234567890],"😀":null,"\ufb33":true}'
    assert tool_calls.parse('{"a": NaN}') == (None, False) and tool_calls.parse("[1]") == ([1], True)
    assert tool_calls.violations(True, {"type": "integer"}) == ["$: type"] and tool_calls.violations(3.0, {"type": "integer"}) == []


def test_odd_json_is_an_error_or_has_a_stated_form(spark):
    """Valid JSON at the edge of what can be stored: every row gives a result."""
    big = "9" * 400
    texts = {
        "float": '{"n": 1e400}', "lone": '{"n": 1, "s": "\\ud800", "\\udfff": 2}', "big": f'{{"n": {big}}}', "deep": '{"n": ' + "[" * 3000 + "]" * 3000 + "}",
        "deeper": "[" * 200_000, "digits": '{"n": ' + "9" * 9000 + "}", "twice": '{"n": 0, "n": 3}', "pair": '{"n": 1, "s": "\\ud83d\\ude00"}',
        "allowed": "[" * 200 + "]" * 200, "small": '{"n": 1e-400}',
    }
    rows = {r["call_id"]: r for r in formatted(spark, [(1, i, k, "t", v, None) for i, (k, v) in enumerate(texts.items())], [])}
    assert len(rows) == len(texts)
    for name in ("float", "deep", "deeper", "digits"):
        assert rows[name]["errors"] == ["invalid_json"] and rows[name]["message"].startswith('{"arguments":null,')
    assert rows["lone"]["errors"] == ["$.s: enum", "$.\\udfff: additionalProperties"]
    assert rows["lone"]["message"] == '{"arguments":{"n":1,"s":"\\ud800","\\udfff":2},"id":"lone","name":"t","result":null}'
    assert json.loads(rows["lone"]["message"])["arguments"]["s"] == "\ud800"
    assert rows["big"]["valid"] and f'"n":{big}' in rows["big"]["message"]
    assert rows["twice"]["valid"] and rows["pair"]["errors"] == ["$.s: enum"] and '"😀"' in rows["pair"]["message"]
    assert rows["allowed"]["errors"] == ["$: type"] and rows["small"]["errors"] == ["$.n: minimum"]


def test_schemas_that_cannot_be_read():
    assert tool_calls.errors_of({}, None) == tool_calls.errors_of({}, [1]) == ["invalid_schema"]
    assert tool_calls.errors_of({"a": 1}, {"properties": {"a": {"minimum": "x"}}}) == ["invalid_schema"]
    assert tool_calls.errors_of(1, {"type": "whole"}) == ["$: type"] and tool_calls.errors_of(1, {"type": ["whole", "integer"]}) == []


def _places(calls, results):
    """Places by the definition: relax every need until nothing moves; what never settles is on a cycle or waits for one."""
    first_call, first_result = {}, {}
    for pos, cid, needs in sorted(calls, key=lambda c: c[:2]):
        first_call.setdefault(cid, (pos, needs))
    for pos, cid in sorted(results):
        first_result.setdefault(cid, pos)
    needs = {c: {n for n in wanted if n != c and n in first_call and n in first_result} for c, (_, wanted) in first_call.items()}
    place = {c: (pos, 0) for c, (pos, _) in first_call.items()}
    for _ in range(len(place) + 1):
        for c in place:
            for n in needs[c]:
                p, d = max((first_result[n], 0), (place[n][0], place[n][1] + 1))
                place[c] = max(place[c], (p, d + 1))
    return place


def test_places_against_relaxation(spark):
    """Random conversations without cycles, with repeated and loose ids, against the plain definition."""
    rng = random.Random(12)
    calls, results, want = [], [], {}
    for conv in range(8):
        order = [f"c{i}" for i in range(12)]
        rng.shuffle(order)
        own, back = [], []
        for i, name in enumerate(order):
            own.append((rng.randint(0, 30), name, rng.sample(order[:i], min(i, rng.randint(0, 2))) + ["nobody", name][: rng.randint(0, 2)]))
            if rng.random() < 0.8:
                back.append((rng.randint(0, 45), name))
        back += [(60 + i, name) for i, name in enumerate(order[:3])]
        calls += [(conv, pos, name, "t", "{}", needs) for pos, name, needs in own]
        results += [(conv, pos, name, "r") for pos, name in back]
        want |= {(conv, c): place for c, place in _places(own, back).items()}
    rows = formatted(spark, calls, results)
    assert {(r["conv_id"], r["call_id"]): (r["order_pos"], r["order_depth"]) for r in rows if r["status"] in ("linked", "no_result")} == want


def test_calls_from_conversations(spark):
    from tidemark.llm.queries import derived_calls

    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "r"), (1, 3, "assistant", "x y"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    calls, results = derived_calls(turns)
    assert [(r["call_id"], r["needs"]) for r in calls.orderBy("pos").collect()] == [("call-1-1", ["call-1--1"]), ("call-1-3", ["call-1-1"])]
    assert [r["call_id"] for r in results.collect()] == ["call-1-1"]
    assert tool_calls.link(calls, results).where(F.col("status") == "linked").count() == 1
