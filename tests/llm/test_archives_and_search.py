"""WARC round trips, quotations and top-k against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import topk, warc
from chalkline.llm.quotes import parse, reply_ordered, units
from chalkline.llm.scratch import Scratch
from chalkline.llm.topk import SortedLists, basis_of, exact_top_k, quantised


def round_trip(spark, rows, parts=3):
    path = Scratch(spark, f"test-{uuid.uuid4().hex}").where("warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), path, "page_id", "url", "html")
    return warc.read_warc(spark, path).collect()


def test_magic_inside_payloads(spark):
    """Payloads hold magics, whole records and broken headers; small splits cut files anywhere."""
    r = random.Random(1)
    bits = [warc.MAGIC, "abc", "é", warc.END, "Content-Length: 5\r\n", "x" * 50]
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    rows = [(i, "http://a\r\nb", inner * (i % 3) if i % 9 == 4 else "same" if i % 7 == 0 else "".join(r.choices(bits, k=r.randrange(30)))) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", inner + warc.MAGIC)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = {int(x["record_id"]): x for x in round_trip(spark, rows)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(j for j, _, other in rows if (other or "") == (html or ""))
        x = found[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (x["record_type"], x["refers_to"]) == (("response", None) if first == i else ("revisit", str(first)))
        assert x["stated_digest"] == x["payload_digest"]


def test_headers_in_payloads_can_state_any_length(spark):
    bad = ["9223372036854775807", "9223372036854775000", "1152921504606846976", "99999999999999999999", "-1", "1e3", ""]
    rows = [(i, "u", f"{warc.MAGIC}Content-Length: {n}\r\n\r\nx{warc.END}") for i, n in enumerate(bad)]
    found = round_trip(spark, rows)
    assert {(int(x["record_id"]), x["payload_bytes"]) for x in found} == {(i, len(t)) for i, _, t in rows}


def test_warc_edges(spark):
    assert round_trip(spark, [], 1) == []
    same = round_trip(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "a")])
    assert sorted((x["record_id"], x["record_type"]) for x in same) == [("1", "response"), ("1", "response"), ("2", "revisit"), ("none", "revisit")]


def test_quote_parsing():
    assert parse("hi\n> a\n> b\n>> c\nbye") == ("hi\nbye", [(1, "a\nb"), (2, "c")])
    assert parse(" > > deep") == ("", [(2, "deep")])
    assert parse("") == ("", [])
    assert set(units("A  b")) == set(units("a B")) and units(" \n") == {}


def test_reply_order(spark):
    rows = [
        (1, 0, "u", "Hello there\nhow are you"),
        (1, 1, "a", "fine thanks\n\nand you?"),
        (1, 2, "u", ">  hello   THERE\nI asked first"),
        (1, 3, "a", "> > hello there\n> I asked first\nok"),
        (1, 4, "u", "> And you?\ngood"),
        (1, 7, "u", None),
        (2, 0, "u", ""),
        (2, 1, "a", "> nothing known\nx"),
        (None, 1, "u", "> a"),
        (3, None, "u", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): r for r in reply_ordered(df).collect()}
    assert len(found) == len(rows)
    want = {(1, 0): (None, 0, 0), (1, 1): (0, 0, 0), (1, 2): (0, 2, 0), (1, 3): (2, 2, 0), (1, 4): (1, 4, 0), (1, 7): (None, 7, 7), (2, 1): (0, 0, 0)}
    assert {k: (found[k]["parent_turn"], found[k]["branch_turn"], found[k]["root_turn"]) for k in want} == want
    rows = [(9, 0, "u", "ok"), (9, 1, "a", "long one"), (9, 2, "u", "ok"), (9, 3, "a", "> ok"), (9, 3000, "u", "> long one"), (9, 3001, "u", "ok\n> ok"), (9, 3002, "a", "> ok")]
    later = {r["turn"]: r["quoted_turn"] for r in reply_ordered(spark.createDataFrame(rows, df.schema)).collect()}
    assert later == {0: None, 1: None, 2: None, 3: 2, 3000: 1, 3001: 2, 3002: 3001}
    assert found[1, 3]["text"] == "ok" and found[1, 3]["n_quotes"] == 2 and found[1, 7]["text"] is None
    assert reply_ordered(spark.createDataFrame([], df.schema)).collect() == []


@pytest.mark.parametrize("high", [3, 1000, 1 << 40])
def test_threshold_search(high):
    r = np.random.default_rng(high)
    ids, vectors = r.permutation(400), r.integers(-high, high, (400, 6))
    lists = SortedLists(ids, vectors)
    for q in range(20):
        query = r.integers(-high, high, 6) * (r.random(6) < 0.7)
        exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
        best = sorted((-s, i) for s, i in zip(exact, ids) if i != q)[:10]
        got_ids, got = lists.top(q, query, 10)
        assert [(-int(s), int(i)) for i, s in zip(got_ids, got)] == best


@pytest.mark.parametrize("decay,most", [(0.6, 0.25), (1.0, 1.0)])
def test_the_bound_stops_where_variance_is_uneven(decay, most):
    """Vectors that live in a few directions, turned away from the axes: a small part is met, and the result is exact."""
    r = np.random.default_rng(4)
    n, dims = 4000, 24
    turn = np.linalg.qr(r.normal(size=(dims, dims)))[0]
    vectors = np.floor(1024 * (r.normal(size=(n, dims)) * decay ** np.arange(dims)) @ turn).astype(np.int64)
    lists = SortedLists(np.arange(n), vectors, basis_of(vectors.astype(np.float64)))
    for q in range(0, n, 100):
        ids, got = lists.top(q, vectors[q], 10)
        scores = vectors @ vectors[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:10]
        assert [(-int(s), int(i)) for i, s in zip(ids, got)] == want
        floor = lists.top(q, vectors[q], 10, float(-want[4][0]))[0].tolist()
        assert floor[:5] == [i for _, i in want[:5]]
    assert lists.met <= most * 80 * n


def test_top_k_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(np.int64)
    found = exact_top_k(df, "vec_id", quantised(F.col("embedding")), F.col("vec_id") % 100 == 0, 10).collect()
    want = {(q, n + 1, i, -s) for q in range(0, 900, 100) for n, (s, i) in enumerate(sorted((-int(x), i) for i, x in enumerate(whole @ whole[q]) if i != q)[:10])}
    assert {tuple(x) for x in found} == want


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = exact_top_k(df, "vec_id", quantised(F.col("embedding")), F.col("vec_id") % 100 == 0, 10).collect()
    top = 1024 * 1024 + 2048 * 2048
    want = {(0, 1, 100, top), (0, 2, 1, 512 * 1024 - 1024 * 2048), (100, 1, 0, top), (100, 2, 0, top), (100, 3, 1, 512 * 1024 - 1024 * 2048)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want
    assert exact_top_k(spark.createDataFrame([], df.schema), "vec_id", quantised(F.col("embedding")), F.lit(True)).collect() == []
