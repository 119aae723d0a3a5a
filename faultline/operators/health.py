"""Source checks: normalisation, summaries, volume and schema drift, state of all sources at a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.timeline import Timeline, asof_join, with_previous

# Sources whose states one row of the scan carries; more take more rows, so a plan's width does not grow with their number.
SOURCES_A_ROW = 16


def normalize_source_checks(checks: DataFrame) -> DataFrame:
    """Probe outcomes as (reachable, latency_ms, error_message).

    ``exception_kind`` is null for an answered probe, else ``timeout``, ``connect`` or anything else.
    """
    kind, text = F.col("exception_kind"), F.coalesce(F.col("exception_text"), F.lit(""))
    source_type = F.coalesce(F.col("source_type"), F.lit("api"))
    is_api, is_database = F.col("source_type") == "api", F.col("source_type") == "database"
    answered = kind.isNull()
    right_status = F.coalesce(F.col("status_code") == F.coalesce(F.col("expected_status"), F.lit(200)), F.lit(False))
    reachable = F.when(is_api, answered & right_status).when(is_database, answered).otherwise(F.lit(False))
    error = (
        F.when(is_api & answered & ~right_status,
               F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit(""))))
        .when(is_api & (kind == "timeout"), F.lit("Timeout"))
        .when(is_api & (kind == "connect"), F.concat(F.lit("Connection failed: "), text))
        .when(is_database & (kind == "timeout"), F.lit("Connection timeout"))
        .when((is_api | is_database) & kind.isNotNull(), text)
        .when(~is_api & ~is_database, F.concat(F.lit("Unknown source type: "), F.col("source_type")))
    )
    return (
        checks.withColumn("source_name", F.coalesce(F.col("source_name"), F.lit("unknown")))
        .withColumn("source_type", source_type)
        .withColumn("reachable", reachable)
        .withColumn("error_message", error)
        .withColumn("latency_ms", F.when((is_api | is_database) & answered, F.col("latency_ms")))
    )


# Buckets per octave, and the number that keeps those of positive values apart from those of negative ones.
OCTAVE_BUCKETS, BUCKET_SHIFT = 64, 1_000_000


def value_bucket(value: Column) -> Column:
    """A number that grows with the value, by octaves: values of any unit and size spread over many buckets."""
    octave = F.floor(F.log2(F.abs(value)) * OCTAVE_BUCKETS) + BUCKET_SHIFT
    return F.when(value > 0, octave).when(value < 0, -octave).otherwise(F.lit(0))


def exact_percentile(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Interpolated percentile per key, exact, without collecting a key's values into one task.

    Equal values are counted first, then counted again per bucket of about 1 % width; the buckets' running totals name the
    one or two buckets that hold the wanted ranks, and only their values are ordered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_bucket", value_bucket(F.col("_v").cast("double")))
    buckets = counted.groupBy(key, "_bucket").agg(F.sum("_n").alias("_bn"))
    per_key = Window.partitionBy(key)
    ordered = per_key.orderBy("_bucket")
    position = F.lit(q) * (F.sum("_bn").over(per_key) - 1)
    ranked = buckets.select(
        key, "_bucket", position.alias("_pos"), (F.sum("_bn").over(ordered) - F.col("_bn")).alias("_before"), "_bn"
    )
    low, high = F.floor("_pos"), F.ceil("_pos")
    holding = ranked.where(
        low.between(F.col("_before"), F.col("_before") + F.col("_bn") - 1)
        | high.between(F.col("_before"), F.col("_before") + F.col("_bn") - 1)
    )
    values = counted.join(holding, [key, "_bucket"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_bucket").orderBy("_v"))
    placed = values.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))
    found = placed.groupBy(key, "_pos").agg(at(low).alias("_lo"), at(high).alias("_hi"))
    return found.select(key, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - low)).alias("percentile"))


def source_summary(checks: DataFrame) -> DataFrame:
    """Checks, reachable share, mean and 95th percentile of the latency per source."""
    base = checks.groupBy("source_name").agg(
        F.count("*").alias("checks"),
        F.avg(F.col("reachable").cast("double")).alias("reachable_share"),
        F.avg("latency_ms").alias("latency_mean"),
    )
    p95 = exact_percentile(checks, "source_name", "latency_ms", 0.95).withColumnRenamed("percentile", "latency_p95")
    return base.join(p95, "source_name", "left")


def with_drift(checks: DataFrame, order: str = "check_id") -> DataFrame:
    """Adds the previous row count, its change, the volume flag, and the columns added and removed since."""
    previous = with_previous(
        checks, ["source_name"], "last_checked", [order], {"_previous": F.struct("row_count", "columns")}
    )
    before, now = F.col("_previous.row_count"), F.col("row_count")
    old, new = F.col("_previous.columns"), F.col("columns")
    added = F.when(old.isNotNull() & new.isNotNull(), F.sort_array(F.array_except(new, old)))
    removed = F.when(old.isNotNull() & new.isNotNull(), F.sort_array(F.array_except(old, new)))
    return (
        previous.withColumn("row_count_previous", before)
        .withColumn("row_count_delta_pct", F.when(before != 0, (now - before) / before * 100))
        .withColumn("columns_added", added)
        .withColumn("columns_removed", removed)
        .withColumn("schema_changed", F.coalesce(F.size(added) + F.size(removed) > 0, F.lit(False)))
        .withColumn("volume_anomaly", F.coalesce((now == 0) | ((before > 0) & (now >= 10 * before)), F.lit(False)))
        .drop("_previous")
    )


def health_struct() -> Column:
    return F.struct(
        "source_name", "source_type", "reachable", "latency_ms", "error_message", "row_count",
        "row_count_previous", "row_count_delta_pct", "schema_changed", "last_checked",
    )


def source_health_asof(
    failures: DataFrame, checks: DataFrame, sources: list[str], time: str = "failed_at", order: str = "check_id"
) -> DataFrame:
    """Adds ``sources``: the newest check of every configured source at or before the failure, in their given order."""
    columns = [c for c in failures.columns if c != "sources"]
    keyed = failures.select(*columns, F.sha2(F.to_json(F.struct(*columns)), 256).alias("_key"))
    found = sources_at(keyed, checks, sources, "_key", time, order)
    none = F.array().cast(dict(found.dtypes)["sources"])
    return keyed.join(found, "_key", "left").select(*columns, F.coalesce("sources", none).alias("sources"))


def sources_at(
    failures: DataFrame, checks: DataFrame, sources: list[str], key: str, time: str = "failed_at", order: str = "check_id"
) -> DataFrame:
    """(key, sources) for failures with any check before them.

    Sources are values of one time line, ``SOURCES_A_ROW`` of them in a group, so a failure's key and time go through the scan once
    for a group, not once for each source.  Of a key that comes with several times the latest counts.
    """
    names = list(dict.fromkeys(sources))
    groups = range(-(-len(names) // SOURCES_A_ROW))
    # One group is a time line without a key.
    on = ["_group"] if len(groups) > 1 else []
    asked = failures.groupBy(key).agg(F.max(time).alias(time))
    if on:
        asked = asked.withColumn("_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    number = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("source_name")) - 1
    shaped = checks.where(F.col("source_name").isin(names)).select(
        F.floor(number / SOURCES_A_ROW).cast("int").alias("_group"), F.pmod(number, F.lit(SOURCES_A_ROW)).alias("_slot"),
        "last_checked", order, health_struct().alias("health"))
    slots = {f"_health{i}": F.when(F.col("_slot") == i, F.col("health")) for i in range(min(SOURCES_A_ROW, len(names)))}
    none = F.array().cast(f"array<{dict(shaped.dtypes)['health']}>")
    if not slots:
        return asked.where("false").select(key, none.alias("sources"))
    seen = asof_join(asked, [Timeline(shaped, "last_checked", slots, (order,))], on, time)
    listed = F.filter(F.array(*[F.col(n) for n in slots]), lambda x: x.isNotNull())
    found = seen.select(key, *on, listed.alias("sources")).where(F.size("sources") > 0)
    if not on:
        return found
    ordered = F.sort_array(F.collect_list(F.struct("_group", "sources")))
    return found.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["sources"])).alias("sources"))
