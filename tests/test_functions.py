"""Golden cases of the pure functions."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtide.functions import blake, cron, rules
from jobtide.functions import scalars as S


def test_blake3_vectors():
    # Published vectors: inputs of so many bytes, 0 to 250 repeating.
    data = lambda n: bytes(i % 251 for i in range(n))
    assert blake.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake.blake3(data(1)).hex().startswith("2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213")
    assert blake.blake3(data(3073)).hex().startswith("7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3")


def test_keys_and_signatures():
    assert blake.unique_key("k", args='{"b":1,"a":2}') == blake.unique_key("k", args='{"a": 2, "b": 1}')
    assert len({blake.unique_key("k"), blake.unique_key("k", "q"), blake.unique_key("k", None, '"q"'), blake.unique_key("k", period=0)}) == 4
    secret = bytes(range(32))
    assert blake.verify(secret, "cb", blake.sign(secret, "cb")) and not blake.verify(secret, "cb", blake.sign(secret, "other"))
    assert 0 <= blake.partition_hash(b"x") < 1 << 64 and blake.partition_name("q", 0) == "q" and blake.partition_name("q", 2) == "q__p2"


def test_ordering_hash_agrees(spark):
    keys = ["", "a", "customer-42", "ñandú"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.ordering_hash(F.col("k")).alias("h")).collect()
    assert {r["k"]: int(r["h"]) for r in got} == {k: blake.ordering_hash(k.encode()) for k in keys}


def test_snake(spark):
    pairs = {"SendEmail": "send_email", "HTMLParser": "html_parser", "HTTPServer": "http_server", "simple": "simple", "A": "a", "ProcessV2Import": "process_v2_import"}
    got = spark.createDataFrame([(k,) for k in pairs], "k string").select("k", S.snake(F.col("k")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == pairs


def test_trace_and_urls(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    rows = spark.createDataFrame([(good,), (good.replace("00-", "ff-", 1),), ("00-" + "0" * 32 + "-" + "b" * 16 + "-01",), ("x",)], "h string")
    assert [r[0] for r in rows.select(S.trace_id(F.col("h"))).collect()] == ["a" * 32, None, None, None]
    assert spark.range(1).select(S.callback_url(F.lit("http://h/x//"), F.lit("/y"))).first()[0] == "http://h/x/y"


def test_nul_and_errors(spark):
    assert spark.range(1).select(S.without_nul(F.lit('{"a":1}'))).first()[0] == '{"a":1}'
    with pytest.raises(Exception, match="NUL"):
        spark.range(1).select(S.without_nul(F.lit("a\\u0000"))).collect()
    e = spark.createDataFrame([('[{"attempt":1,"error":"x","at":"2024-01-01T00:00:00Z"}]',), ("[]",), ("{}",), (None,)], "t string").select(S.json_errors(F.col("t")).alias("e")).collect()
    assert e[0]["e"][0]["terminal"] is False and [r["e"] for r in e[1:]] == [None, None, None]


@pytest.mark.parametrize(
    ("expression", "zone", "after", "fire"),
    [
        ("0 * * * *", "UTC", "2024-01-01 10:00", "2024-01-01 11:00"),
        ("*/20 * * * * *", "UTC", "2024-01-01 10:00", "2024-01-01 10:00:20"),
        ("30 2 * * *", "America/New_York", "2024-03-09 12:00", "2024-03-11 06:30"),  # the clock skips 02:30 on the 10th
        ("30 1 * * *", "America/New_York", "2024-11-03 04:00", "2024-11-03 05:30"),  # the first of two 01:30
        ("0 0 29 2 *", "UTC", "2024-03-01 00:00", "2028-02-29 00:00"),
        ("0 12 1 * MON", "UTC", "2024-05-02 00:00", "2024-05-06 12:00"),
    ],
)
def test_cron(expression, zone, after, fire):
    parse = datetime.fromisoformat
    assert cron.Cron.parse(expression, zone).after(parse(after)) == parse(fire)


def test_cron_policies():
    now, day = datetime(2024, 1, 2, 12, 30), datetime(2024, 1, 2, 9, 0)
    assert cron.owed("0 * * * *", "UTC", "coalesce", day, day, False, now) == [datetime(2024, 1, 2, 12)]
    assert len(cron.owed("0 * * * *", "UTC", "catch_up", day, day, False, now)) == 3
    assert cron.owed("* * * * *", "UTC", "catch_up", day, day, False, now, 5)[-1] == datetime(2024, 1, 2, 9, 5)
    assert cron.owed("0 * * * *", "UTC", "catch_up", None, datetime(2024, 1, 2, 12, 0), False, now) == [datetime(2024, 1, 2, 12)]
    assert cron.owed("0 * * * *", "UTC", "catch_up", day, day, True, now) == []


@pytest.mark.parametrize(
    ("rule", "payload", "value"),
    [
        ('payload.a == "x" && payload.n > 2', {"a": "x", "n": 3}, True), ("!(payload.n < 2) || false", {"n": 3}, True), ('payload.s.contains("b")', {"s": "abc"}, True),
        ("size(payload.l) == 2", {"l": [1, 2]}, True), ("has(payload.x)", {}, False), ('payload.n > 1 ? "big" : "small"', {"n": 2}, "big"), ('payload["k"] in [1, 2]', {"k": 2}, True),
    ],
)
def test_rules(rule, payload, value):
    assert rules.Rule(rule)(payload) == value


def test_rules_are_refused():
    for bad in ("payload.", "os.system", "__import__('x')"):
        with pytest.raises(ValueError):
            rules.Rule(bad)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 4), st.integers(0, 10**6), st.integers(0, 5000))
def test_effective_priority_bounds(p, waited, aging):
    want = p if aging <= 0 else max(1, p - waited // aging)
    assert 1 <= want <= p
