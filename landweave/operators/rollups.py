"""Grouped analytics: totals, percentiles, portfolios, trends, gaps and rankings.

All are hash aggregations or windows over keys that occur in the data; money is summed as decimals, so totals do not
depend on the order of rows. A mean is the exact total over the count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def total(c: str | Column, name: str) -> Column:
    return F.sum(money(c)).alias(name)


def _mean(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double") / F.nullif(F.count(c), F.lit(0))


def mean(c: str | Column, name: str) -> Column:
    return _mean(c).alias(name)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group, each a column."""
    p = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares.values()))).alias("_p"))
    return p.select(*keys, *[F.round(F.col("_p")[i], 4).alias(k) for i, k in enumerate(shares)])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the limit also runs before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def ordering(text: str) -> list[Column]:
    """Columns of an ORDER BY list whose items are a name, ASC or DESC, and NULLS FIRST or LAST."""
    out = []
    for item in text.split(","):
        name, way, *nulls = item.split()
        out.append(getattr(F.col(name), f"{way}_nulls_{nulls[1]}".lower())())
    return out


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their place from 1; only these come together in one task."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(W.orderBy(*order)))


def most_frequent(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per group, of equally frequent ones the least."""
    by = df.groupBy(*keys, value).agg(n("_n"))
    return by.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("k"), F.col(value))).alias(name))


def discovery(parcels: DataFrame, entities: DataFrame, least: int, limit: int) -> DataFrame:
    """Owners who are entities and hold at least ``least`` parcels, largest holdings first.

    Entities are counted per name before the join, so several of one name do not multiply parcels."""
    named = entities.groupBy(F.upper(F.trim("name")).alias("_k")).agg(n("entities"))
    held = parcels.where("owner_name is not null").groupBy("owner_name").agg(n("properties"), total("market_value", "total_value")).where(F.col("properties") >= least)
    met = held.join(named, F.upper(F.trim("owner_name")) == F.col("_k"))
    return met.select("owner_name", "entities", "properties", "total_value").orderBy(F.desc("properties"), F.desc_nulls_last("total_value"), "owner_name").limit(limit)


def facets(holdings: DataFrame, as_of: Column) -> DataFrame:
    """Counts by type, city, zoning and year of sale, and by month of the last twelve; one pass over the rows."""
    recent = F.col("last_sale_date") >= F.add_months(as_of, -12)

    def pair(k: str, c: Column) -> Column:
        return F.struct(F.lit(k).alias("facet"), c.alias("bucket"))

    fixed = [pair("type", F.col("property_type")), pair("city", F.col("city")), pair("zoning", F.col("land_zoning_code")), pair("year", F.year("last_sale_date").cast("string"))]
    each = F.when(recent, F.array(*fixed, pair("month", F.date_format("last_sale_date", "yyyy-MM")))).otherwise(F.array(*fixed))
    return holdings.select(F.explode(each).alias("x")).groupBy("x.facet", "x.bucket").agg(n())


def portfolio(holdings: DataFrame, keys: list[str]) -> DataFrame:
    return holdings.groupBy(*keys).agg(n("properties"), F.sum("market_value").alias("total_value"), F.array_sort(F.collect_list("parcel_id")).alias("ids"), F.min("sale_date").alias("first_activity"), F.max("sale_date").alias("last_activity"))


def market_overview(parcels: DataFrame, as_of: Column, days: int) -> DataFrame:
    return parcels.groupBy("market_id").agg(n("parcels"), F.count_distinct("owner_name").alias("owners"), total("market_value", "value"), mean("market_value", "mean_value"), F.count_if(F.col("last_sale_date") >= F.date_sub(as_of, days)).alias("recent_sales"))


def demand(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Number of sales, mean value now and at sale, and the rise of the one over the other in percent."""
    now, then = _mean("market_value"), _mean("last_sale_price")
    return sales.groupBy(*keys).agg(n("sales"), now.alias("now_mean"), then.alias("sale_mean"), F.round((now - then) / F.nullif(then, F.lit(0.0)) * 100, 6).alias("appreciation"))


def active_buyers(sales: DataFrame, top: int) -> DataFrame:
    """The owners with most sales per market and their share of all."""
    by = sales.groupBy("market_id", "owner_name").agg(n("bought"))
    all_ = by.groupBy("market_id").agg(F.sum("bought").alias("_all"))
    best = top_per_group(by.where("owner_name is not null"), ["market_id"], [F.desc("bought"), F.asc("owner_name")], top)
    return best.join(all_, "market_id").select("market_id", "owner_name", "bought", F.round(F.lit(100.0) * F.col("bought") / F.col("_all"), 6).alias("share"))


def focus(df: DataFrame, key: str, area: str, top: int) -> DataFrame:
    """The areas a holder has most in, and the share of each of all its holdings."""
    by = df.groupBy(key, area).agg(n())
    w = W.partitionBy(key)
    ranked = by.withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), area))).withColumn("_all", F.sum("n").over(w))
    return ranked.where(F.col("_k") <= top).select(key, area, "n", F.round(F.col("n") / F.col("_all"), 6).alias("concentration"))


def incident_trend(reports: DataFrame, as_of: Column, days: int, violent: list[str]) -> DataFrame:
    """Incidents of the last period against the one before, in one pass; a market without recent ones keeps its row."""
    at, turn = F.col("incident_date").cast("date"), F.date_sub(as_of, days)
    rows = reports.where((at >= F.date_sub(as_of, 2 * days)) & (at < as_of))
    recent = at >= turn
    c = rows.groupBy("market_id").agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("prior"), F.count_if(recent & F.col("incident_type").isin(violent)).alias("violent"))
    change = F.round(F.lit(100.0) * (F.col("recent") - F.col("prior")) / F.nullif(F.col("prior"), F.lit(0)), 6)
    return c.select("*", change.alias("change"), F.round(F.col("violent") / F.nullif(F.col("recent"), F.lit(0)), 6).alias("violent_share"))


def top_developers(permits: DataFrame, top: int, latest: int) -> DataFrame:
    """The applicants with most permits, each with its latest ones."""
    by = permits.groupBy("applicant_id").agg(n("permits"), F.sum("project_value").alias("value")).orderBy(F.desc("permits"), "applicant_id").limit(top)
    order = [F.desc("applied"), "parcel_id", "line", "part_id", "contractor_id", "project_value"]
    mine = permits.join(F.broadcast(by), "applicant_id")  # ``top`` rows
    ranked = mine.withColumn("_r", F.row_number().over(W.partitionBy("applicant_id").orderBy(*order))).where(F.col("_r") <= latest)
    named = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "parcel_id", "permit_type").alias("x")))), lambda s: s["x"])
    return ranked.groupBy("applicant_id", "permits", "value").agg(named.alias("latest"))


def contractor_performance(permits: DataFrame) -> DataFrame:
    """Completion rate, mean days to the end and experience by number of permits (5, 20, 50)."""
    c = permits.groupBy("contractor_id").agg(n("permits"), F.count_if(F.col("work_type") == "F").alias("_done"), F.sum(F.datediff("finished", "applied")).alias("_days"), F.count("finished").alias("_timed"))
    level = F.when(F.col("permits") >= 50, "expert").when(F.col("permits") >= 20, "experienced").when(F.col("permits") >= 5, "established").otherwise("new")
    return c.select("contractor_id", "permits", F.round(F.col("_done") / F.col("permits"), 6).alias("completion_rate"), (F.col("_days") / F.nullif(F.col("_timed"), F.lit(0))).alias("mean_days"), level.alias("experience"))


def absorption(parcels: DataFrame, keys: list[str], as_of: Column, days: int) -> DataFrame:
    """Annualised sales rates of the whole and the half period, months of inventory, class (15, 20) and trend (2).

    ``days`` is kept between 30 and 730. Months are null without sales."""
    days = min(730, max(30, days))
    half = days // 2
    sold = F.col("last_sale_date")
    c = parcels.groupBy(*keys).agg(n("inventory"), F.count_if(sold >= F.date_sub(as_of, days)).alias("full_sales"), F.count_if(sold >= F.date_sub(as_of, half)).alias("half_sales"))
    yearly = F.lit(365.0 / days)
    full, halved = F.col("full_sales") / F.col("inventory") * 100 * yearly, F.col("half_sales") / F.col("inventory") * 100 * yearly * 2
    months = F.col("inventory") / F.nullif(F.col("half_sales") / F.lit(half / 30.0), F.lit(0.0))
    kind = F.when(months < 15, "fast").when(months <= 20, "balanced").when(months > 20, "slow")
    trend = F.when(F.abs(halved - full) < 2, "stable").when(halved > full, "rising").otherwise("falling")
    return c.select(*keys, "inventory", "full_sales", "half_sales", F.round(full, 1).alias("full_rate"), F.round(halved, 1).alias("half_rate"), F.round(months, 1).alias("months"), kind.alias("market_class"), trend.alias("trend"))


def bands(confidence: str, suffix: str = "") -> dict[str, Column]:
    """Conditions of the confidence bands at 0.85 and 0.60."""
    c = F.col(confidence)
    return {f"high{suffix}": c >= 0.85, f"medium{suffix}": (c >= 0.6) & (c < 0.85), f"low{suffix}": c < 0.6}


def hourly_metrics(decisions: DataFrame, at: str, method: str, confidence: str) -> DataFrame:
    return decisions.groupBy(F.window(at, "1 hour").alias("_w"), method).agg(n(), *[F.count_if(b).alias(k) for k, b in bands(confidence).items()]).select(F.col("_w.start").alias("hour_start"), method, "n", "high", "medium", "low")


def improvements(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Area (unreadable values skipped), number, kinds, years and keyword flags per parcel."""
    year = F.year("applied")
    return rows.groupBy("parcel_id").agg(F.sum(F.expr("try_cast(quantity AS double)")).alias("square_feet"), n(), F.count_distinct("permit_type").alias("kinds"), F.min(F.when(year > 0, year)).alias("first_year"), F.max(year).alias("last_year"), *[F.bool_or(F.col("permit_type").contains(w)).alias(k) for k, w in flags.items()])


def latest_year_totals(rows: DataFrame, key: str, year: Column, amount: str, kind: str) -> DataFrame:
    """Amount and kinds of each key's latest year; the number of rows of all years."""
    by_year = rows.groupBy(key, year.alias("last_year")).agg(F.sum(amount).alias("amount"), F.array_sort(F.collect_set(kind)).alias("types"), n("_n"))
    last = by_year.groupBy(key).agg(F.max_by(F.struct("last_year", "amount", "types"), "last_year").alias("_l"), F.sum("_n").alias("n"))
    return last.select(key, "_l.*", "n")


def agent_services(entities: DataFrame, least: int) -> DataFrame:
    """Registered agents of at least so many entities."""
    agent = F.upper(F.trim("registered_agent"))
    return entities.where(agent != "").groupBy(agent.alias("agent")).agg(F.count_distinct("id").alias("entities")).where(F.col("entities") >= least)


def completeness(df: DataFrame, key: str, shares: dict[str, str], unique: str) -> DataFrame:
    """Percent of rows per group that have a value, by column, and how often ``unique`` repeats."""
    return df.groupBy(key).agg(n(), *[F.round(F.lit(100.0) * F.count(c) / F.count(F.lit(1)), 6).alias(k) for k, c in shares.items()], (F.count(unique) - F.count_distinct(unique)).alias("duplicates"))


def mentions(documents: DataFrame, subject: str, word: str, newest: int, many: int) -> DataFrame:
    """How often documents about a subject mention a word, the newest ones, and whether that is often."""
    hit = documents.where(F.col(subject).isNotNull() & F.lower("text").contains(word.lower())).select(F.col(subject).alias("subject"), "doc_id", "published_date")
    counts = hit.groupBy("subject").agg(n("mentions"))
    best = top_per_group(hit, ["subject"], [F.desc("published_date"), F.asc("doc_id")], newest)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date("published_date")).alias("k"), "doc_id"))), lambda x: x["doc_id"])
    return counts.join(best.groupBy("subject").agg(ordered.alias("newest")), "subject").select("subject", "mentions", "newest", (F.col("mentions") > many).alias("frequent"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), [df.agg(n()).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])


def unique_owners(parcels: DataFrame, sample: int = 3) -> DataFrame:
    """Owners with their number of parcels, an address and city, and the first parcels by key."""
    p = parcels.where("owner_name is not null and trim(owner_name) != ''")
    by = p.groupBy("owner_name").agg(n(), F.max("mailing_address").alias("address"), F.max("city").alias("city"))
    keys = top_per_group(p.select("owner_name", "parcel_key").distinct(), ["owner_name"], [F.asc("parcel_key")], sample)
    return by.join(keys.groupBy("owner_name").agg(F.array_sort(F.collect_list("parcel_key")).alias("sample")), "owner_name")


def lifecycle_dedupe(rows: DataFrame, keys: list[str], status: str, priority: list[str], ties: list[Column]) -> DataFrame:
    """One row per key: the furthest stage by priority."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(status)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    return top_per_group(rows.withColumn("_p", rank), keys, [F.asc("_p"), F.asc(status), *ties], 1).drop("_p")


def street_gaps(parcels: DataFrame, market: str, address: str, step: int = 2) -> DataFrame:
    """House numbers missing between neighbours of a street that are more than two steps apart."""
    a = F.col(address)
    s = parcels.where(a.rlike("^[0-9]{1,9} ")).select(market, F.regexp_replace(F.upper(a), "^[0-9]+ ", "").alias("street"), F.regexp_extract(a, "^([0-9]+) ", 1).cast("int").alias("from_no")).distinct()
    w = W.partitionBy(market, "street").orderBy("from_no")
    nxt = s.withColumn("to_no", F.lead("from_no").over(w)).where(F.col("to_no") - F.col("from_no") > 2 * step)
    last = F.col("to_no") - 1
    return nxt.select(market, "street", "from_no", "to_no", F.sequence((F.col("from_no") + step).cast("long"), last.cast("long"), F.lit(step).cast("long")).alias("missing"))


def date_gaps(rows: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """Stretches of more than ``days`` days between active days."""
    active = rows.where(F.col(at).isNotNull()).select(key, F.to_date(at).alias("gap_to")).distinct()
    gaps = active.withColumn("gap_from", F.lag("gap_to").over(W.partitionBy(key).orderBy("gap_to"))).withColumn("days", F.datediff("gap_to", "gap_from"))
    return gaps.where(F.col("days") > days).select(key, "gap_from", "gap_to", "days")
