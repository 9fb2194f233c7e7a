"""Queries of the mergeable sketches: estimates held against the exact answer, also after parts were written and merged."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.operators import sketches
from framewright.session import scratch_path

FRACTIONS = (0.01, 0.25, 0.5, 0.9, 0.999)


def _stored(t, parts):
    """A sketch table in its own files, as a daily job would leave it."""
    path = scratch_path(t.spark)
    parts.write.parquet(path)
    return t.spark.read.parquet(path)


def _by_year(t):
    return t.lineitem.withColumn("year", F.year("l_shipdate"))


@query("select l_returnflag as key, count(distinct l_partkey) as exact, true as within from lineitem group by 1")
def sketch_nuniq(t):
    """Distinct parts of every return flag, from sketches of single years that are merged: within 3 percent of the exact count."""
    parts = _stored(t, sketches.distinct_sketches(_by_year(t), "l_partkey", ("l_returnflag", "year")))
    merged = sketches.merge_distinct(parts, ("l_returnflag",)).select("l_returnflag", sketches.distinct_estimate().alias("estimate"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return exact.join(merged, "l_returnflag").select(F.col("l_returnflag").alias("key"), "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@query(
    "select year(l_shipdate)::varchar as key, count(distinct l_extendedprice) as exact, true as within from lineitem group by 1"
    " union all select 'all', count(distinct l_extendedprice), true from lineitem"
)
def sketch_nuniq_levels(t):
    """One table of sketches of doubles read at two levels: every year, and all years, within 3 percent."""
    parts = _stored(t, sketches.distinct_sketches(_by_year(t), "l_extendedprice", ("year",)))
    years = parts.select(F.col("year").cast("string").alias("key"), sketches.distinct_estimate().alias("estimate"))
    whole = sketches.merge_distinct(parts).select(F.lit("all").alias("key"), sketches.distinct_estimate().alias("estimate"))
    exact = _by_year(t).groupBy(F.col("year").cast("string").alias("key")).agg(F.count_distinct("l_extendedprice").alias("exact"))
    all_rows = t.lineitem.agg(F.count_distinct("l_extendedprice").alias("exact")).select(F.lit("all").alias("key"), "exact")
    both = years.unionByName(whole).join(exact.unionByName(all_rows), "key")
    return both.select("key", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@query(
    "select l_returnflag as key, fraction, count(*) as n, true as within"
    f" from lineitem, unnest([{', '.join(f'cast({f} as double)' for f in FRACTIONS)}]) as f(fraction) group by 1, 2"
)
def sketch_quantiles(t):
    """Quantiles of prices from merged yearly sketches, their ranks counted exactly: within twice the stated rank error."""
    parts = _stored(t, sketches.quantile_sketches(_by_year(t), "l_extendedprice", ("l_returnflag", "year")))
    merged = sketches.merge_quantiles(parts, ("l_returnflag",))
    cuts = merged.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), sketches.quantile(f).alias("cut")) for f in FRACTIONS))).alias("x")).select("l_returnflag", "x.*")
    price = F.col("l_extendedprice")
    error = 2 * sketches.quantile_error()
    ranked = (
        t.lineitem.join(cuts, "l_returnflag")
        .groupBy("l_returnflag", "fraction")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(price < F.col("cut")).alias("below"), F.count_if(price <= F.col("cut")).alias("upto"))
    )
    within = (F.col("below") <= (F.col("fraction") + error) * F.col("n")) & (F.col("upto") >= (F.col("fraction") - error) * F.col("n"))
    return ranked.select(F.col("l_returnflag").alias("key"), "fraction", "n", within.alias("within"))
