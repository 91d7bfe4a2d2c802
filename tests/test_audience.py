from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioscan.operators import audience, render

START = datetime(2024, 1, 1)
OLD = datetime(1901, 2, 3, 4, 5, 6, 7)


def hours(n):
    return START + timedelta(hours=n)


def test_followup_and_suppression(spark):
    accounts = spark.range(4).withColumnRenamed("id", "account")
    events = spark.createDataFrame([(1,), (1,), (3,), (9,)], "user long")
    opened = audience.followup_audience(accounts, events, "account", "user")
    assert sorted(r.account for r in opened.collect()) == [1, 3]
    left = audience.suppress(accounts, events, "account", "user")
    assert sorted(r.account for r in left.collect()) == [0, 2]


def test_first_offer_of_the_unserved(spark):
    offers = spark.createDataFrame(
        [(1, hours(2), 10), (1, hours(1), 12), (1, hours(1), 11), (2, hours(0), 13), (3, OLD, 0), (3, OLD, 9)],
        "account_id long, offered_at timestamp_ntz, offer_id long",
    )
    served = spark.createDataFrame([(2,), (2,)], "account_id long")
    found = sorted(map(tuple, audience.first_offer_only(offers, served).collect()))
    assert found == [(1, hours(1), 11), (3, OLD, 0)]


def test_rates_per_variant(spark):
    events = spark.createDataFrame(
        [(1, "view"), (1, "click"), (1, "click"), (2, "view"), (3, "click"), (5, "view")],
        "user long, kind string",
    )
    rates = audience.variant_rates(
        events, "user", F.pmod("user", F.lit(2)), F.col("kind") == "view", F.col("kind") == "click"
    )
    assert sorted(map(tuple, rates.collect())) == [(0, 1, 0, 0, 0.0), (1, 2, 1, 2, 0.5)]


def test_reply_inside_the_limit(spark):
    schema = "user_id long, ts timestamp_ntz"
    contacts = spark.createDataFrame([(1, hours(5)), (1, hours(0)), (2, hours(0)), (3, hours(0))], schema)
    replies = spark.createDataFrame(
        [(1, hours(0)), (1, hours(48)), (1, hours(49)), (2, hours(49)), (4, hours(1))], schema
    )
    assert list(map(tuple, audience.reply_within(contacts, replies, 48).collect())) == [
        (1, hours(0), hours(48))
    ]


def test_render_takes_values_literally(spark):
    docs = spark.createDataFrame([(7, "Hola {{ name }}, {{url}} {{url}} {{other}}")], "doc_id long, html string")
    sends = spark.createDataFrame(
        [(1, 7, r"$1 \0 {{url}}", "u?a=1&b=2"), (2, 7, None, "v"), (3, 8, "x", "y")],
        "recipient_id long, doc_id long, name string, link string",
    )
    body = {r.recipient_id: r.body for r in render.render(sends, docs, {"url": "link", "name": "name"}).collect()}
    assert body == {
        1: r"Hola $1 \0 {{url}}, u?a=1&b=2 u?a=1&b=2 {{other}}",
        2: "Hola , v v {{other}}",
        3: None,
    }
