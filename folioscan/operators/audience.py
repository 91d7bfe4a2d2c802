"""Who gets a mailing, and who answered.

Event tables hold many rows per account, perhaps a third of all for one. They
are reduced to one row per account, with partial results per task, before they
meet the accounts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.session import staged

#: Offer ids are below this number.
IDS = Decimal(10**19)


def followup_audience(accounts: DataFrame, opens: DataFrame, key: str, by: str) -> DataFrame:
    """Accounts with at least one open; ``key`` of accounts is ``by`` of opens."""
    opened = opens.select(F.col(by).alias(key)).distinct()
    return accounts.join(opened, key, "left_semi")


def suppress(accounts: DataFrame, opt_outs: DataFrame, key: str, by: str) -> DataFrame:
    """Accounts without an opt-out."""
    gone = opt_outs.select(F.col(by).alias(key)).distinct()
    return accounts.join(gone, key, "left_anti")


def first_offer_only(offers: DataFrame, served: DataFrame) -> DataFrame:
    """``account_id, offered_at, offer_id``: the first offer of each account never served.

    ``offers(account_id, offered_at, offer_id)``, ``served(account_id)``; offer ids
    are whole numbers from 0. Time and id make one number, whose minimum is found
    by hashing, where that of a pair would need a sort. Both tables go through one aggregation by account, combined per task. A sorted
    window would gather all offers of an account in one task, and so would an
    anti-join, which the optimizer moves below the aggregation.
    """
    place = F.unix_micros(F.col("offered_at").cast("timestamp")).cast("decimal(38,0)") * F.lit(IDS) + F.col(
        "offer_id"
    ).cast("decimal(20,0)")
    rows = offers.select(
        "account_id", place.alias("place"), F.lit(False).alias("served")
    ).unionByName(
        served.select("account_id", F.lit(True).alias("served")), allowMissingColumns=True
    )
    accounts = rows.groupBy("account_id").agg(
        F.min("place").alias("first"), F.bool_or("served").alias("served")
    )
    waiting = accounts.where(~F.col("served") & F.col("first").isNotNull())
    offer_id = F.pmod(F.col("first"), F.lit(IDS))
    offered_at = F.timestamp_micros(F.call_function("div", F.col("first") - offer_id, F.lit(IDS)))
    kinds = dict(offers.dtypes)
    return waiting.select(
        "account_id",
        offered_at.cast(kinds["offered_at"]).alias("offered_at"),
        offer_id.cast(kinds["offer_id"]).alias("offer_id"),
    )


def variant_rates(
    events: DataFrame, user: str, variant: Column, seen: Column, answered: Column
) -> DataFrame:
    """``variant, n_seen, n_answered, n_answers, rate`` per variant of an A/B test.

    ``variant`` is a function of the user; ``seen`` and ``answered`` are
    conditions on an event. Users who saw nothing do not count.
    """
    per_user = events.groupBy(user).agg(
        F.count_if(seen).alias("seen"), F.count_if(answered).alias("answers")
    )
    reached = per_user.where(F.col("seen") > 0).withColumn("variant", variant)
    totals = reached.groupBy("variant").agg(
        F.count("*").alias("n_seen"),
        F.count_if(F.col("answers") > 0).alias("n_answered"),
        F.sum("answers").alias("n_answers"),
    )
    return totals.withColumn("rate", F.col("n_answered") / F.col("n_seen"))


def reply_within(contacts: DataFrame, replies: DataFrame, hours: int) -> DataFrame:
    """``user_id, contacted_at, replied_at`` of users who reply soon after their first contact.

    Both inputs are ``(user_id, ts)``. The reply is the first one later than the
    contact, and counts if it comes within ``hours``. The first contacts, one
    row per user, are staged: with both sides of the join straight from a
    shuffle, adaptive execution can split a user who holds many replies.
    """
    first = staged(contacts.groupBy("user_id").agg(F.min("ts").alias("contacted_at")), "contacts")
    limit = F.col("contacted_at") + F.expr(f"INTERVAL {int(hours)} HOURS")
    in_time = replies.join(first, "user_id").where(
        (F.col("ts") > F.col("contacted_at")) & (F.col("ts") <= limit)
    )
    # Grouped by user_id itself, the rows would stay where the join put them, and
    # adaptive execution would not split the join.
    contact = F.struct("user_id", "contacted_at").alias("contact")
    replied = in_time.groupBy(contact).agg(F.min("ts").alias("replied_at"))
    return replied.select("contact.*", "replied_at")
