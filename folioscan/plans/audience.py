"""Audience queries over ``customer``, ``orders`` and ``events``.

The tables hold no mailings, so these are stand-ins: a view is an open, an
error an opt-out, a click an answer; an order still open is an offer, and a
customer with a finished urgent order has been served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import audience
from folioscan.plans.query import Query

REPLY_HOURS = 48


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def of_type(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == event_type)


def first_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    offers = orders.where(F.col("o_orderstatus") == "O").select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("offered_at"),
        F.col("o_orderkey").alias("offer_id"),
    )
    served = orders.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    ).select(F.col("o_custkey").alias("account_id"))
    found = audience.first_offer_only(offers, served)
    return found.select("account_id", moment("offered_at").alias("offered_at"), "offer_id")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = of_type(spark, sf_dir, "view").select("user_id", "ts")
    clicks = of_type(spark, sf_dir, "click").select("user_id", "ts")
    found = audience.reply_within(contacts, clicks, REPLY_HOURS)
    return found.select(
        "user_id", moment("contacted_at").alias("contacted_at"), moment("replied_at").alias("replied_at")
    )


def moment(column: str) -> Column:
    """A time without zone as text, whatever the zone of the session."""
    return F.col(column).cast("string")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    variant = F.when(F.pmod("user_id", F.lit(2)) == 0, "A").otherwise("B")
    return audience.variant_rates(
        events(spark, sf_dir), "user_id", variant, kind == "view", kind == "click"
    )


QUERIES = {
    "followup_audience": Query(
        lambda s, d: audience.followup_audience(
            customers(s, d), of_type(s, d, "view"), "c_custkey", "user_id"
        ),
        """SELECT c_custkey, c_name FROM customer
           WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view')""",
    ),
    "suppress": Query(
        lambda s, d: audience.suppress(
            customers(s, d), of_type(s, d, "error"), "c_custkey", "user_id"
        ),
        """SELECT c_custkey, c_name FROM customer
           WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND user_id = c_custkey)""",
    ),
    "first_offer_only": Query(
        first_offers,
        """SELECT account_id, CAST(offered_at AS VARCHAR) AS offered_at, offer_id
            FROM (SELECT o_custkey AS account_id, o_orderdate AS offered_at, o_orderkey AS offer_id,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
                  FROM orders WHERE o_orderstatus = 'O')
            WHERE place = 1 AND account_id NOT IN
                  (SELECT o_custkey FROM orders
                   WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
    ),
    "variant_rates": Query(
        variants,
        """SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant,
                  count(*) AS n_seen, count(*) FILTER (answers > 0) AS n_answered,
                  CAST(sum(answers) AS BIGINT) AS n_answers,
                  CAST(count(*) FILTER (answers > 0) AS DOUBLE) / count(*) AS rate
           FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS seen,
                        count(*) FILTER (event_type = 'click') AS answers
                 FROM events GROUP BY user_id)
           WHERE seen > 0 GROUP BY 1""",
    ),
    "reply_within": Query(
        replies,
        f"""WITH c AS (SELECT user_id, min(ts) AS contacted_at FROM events
                       WHERE event_type = 'view' GROUP BY user_id)
            SELECT user_id, CAST(contacted_at AS VARCHAR) AS contacted_at,
                   CAST(min(ts) AS VARCHAR) AS replied_at
            FROM c JOIN events USING (user_id)
            WHERE event_type = 'click' AND ts > contacted_at
              AND ts <= contacted_at + INTERVAL {REPLY_HOURS} HOUR
            GROUP BY user_id, contacted_at""",
    ),
}
