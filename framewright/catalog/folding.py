"""Queries of blocks that run over the rows of a group in order, next to the windows that say the same."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.operators import fold

# One key holds more than half of all rows.
HOT = "select event_id, case when user_id % 5 < 3 then 0 else user_id end as user_id, event_type, cast(round(value * 100) as bigint) as cents from events"


def hot_events(t):
    return t.events.select(
        "event_id",
        F.when(F.col("user_id") % 5 < 3, 0).otherwise(F.col("user_id")).cast("long").alias("user_id"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


@query(f"select event_id, user_id, cast(sum(cents) over (partition by user_id order by event_id) as bigint) as balance from ({HOT})")
def by_running_balance(t):
    """The running sum of every user's values."""
    return fold.scan(hot_events(t), "user_id", "event_id", fold.running_total("cents"), "balance", "long").select("event_id", "user_id", "balance")


RUNS = f"""
select user_id as key, max(n) as value from (
  select user_id, run, event_type, count(*) as n from (
    select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as run
    from ({HOT}))
  group by all)
group by user_id
"""


@query(RUNS)
def by_longest_run(t):
    """The longest run of events of one type of every user."""
    return fold.fold(hot_events(t), "user_id", "event_id", fold.longest_run("event_type"), "long")


@query(f"""
select event_id, user_id, cast(total - least(0, min(total) over w) as bigint) as balance from (
  select event_id, user_id, sum(cents - 5000) over (partition by user_id order by event_id) as total from ({HOT}))
window w as (partition by user_id order by event_id)
""")
def by_clamped_balance(t):
    """A balance of every user that never falls below zero, 50 taken off each value."""
    moved = hot_events(t).withColumn("moved", F.col("cents") - 5000)
    balance = fold.scan(moved, "user_id", "event_id", fold.clamped_balance("moved"), "balance", "double")
    return balance.select("event_id", "user_id", F.col("balance").cast("long").alias("balance"))
