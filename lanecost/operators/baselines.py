"""Own-history and same-week peer baselines over the weekly table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import band_total, banded, close, failures
from ..schemas import BASELINE_COLUMNS, HISTORY_WEEKS, KEY, require_columns
from .quality import check_table


def history_window():
    """Weeks of a route in order. A partition holds one row per observed week, so its
    size is bounded by the calendar however many shipments the route has."""
    return Window.partitionBy("route", "route_type").orderBy("week_of")


def own_history_baseline(weekly: DataFrame) -> DataFrame:
    """Mean rate of the previous up to eight observed weeks; gaps are skipped."""
    frame = history_window().rowsBetween(-HISTORY_WEEKS, -1)
    return weekly.withColumn(
        "own_history_avg_cost_per_tonne_km", F.avg("cost_per_tonne_km").over(frame))


def history_weeks_used(weekly: DataFrame) -> DataFrame:
    used = F.least(F.row_number().over(history_window()) - 1, F.lit(HISTORY_WEEKS))
    return weekly.withColumn("history_weeks_used", used.cast("long"))


def peer_baseline(weekly: DataFrame) -> DataFrame:
    """(group sum - own) / (n - 1) over the same route type and week.

    A window over (route_type, week) would put every route of a type in one task,
    so the group is pre-aggregated with map-side combine and joined back: the
    aggregate has at most route types x weeks rows and AQE broadcasts it when it
    is measured to be small. Sum and subtraction go by bands of magnitude, so the
    result is independent of row order and small rates survive beside large ones.
    """
    group_key = ["route_type", "week_of"]
    own = weekly.withColumn("_own", banded(F.col("cost_per_tonne_km")))
    group = own.groupBy(*group_key, F.col("_own.band").alias("_band")).agg(
        F.sum("_own.part").alias("part"), F.count(F.lit(1)).alias("n")).groupBy(*group_key).agg(
        F.collect_list(F.struct(F.col("_band").alias("band"), "part")).alias("_sums"), F.sum("n").alias("_group_size"))
    others = F.col("_group_size") - 1
    rest = F.transform("_sums", lambda x: F.struct(
        x["band"].alias("band"), (x["part"] - F.when(x["band"] == F.col("_own.band"), F.col("_own.part")).otherwise(
            F.lit(0).cast("decimal(28,17)"))).alias("part")))
    return (
        own.join(group, group_key)
        .withColumns({
            "peer_routes_used": others,
            "similar_routes_avg_cost_per_tonne_km": band_total(rest) / F.nullif(others, F.lit(0)),
        })
        .drop("_own", "_sums", "_group_size")
    )


def add_baselines(weekly: DataFrame) -> DataFrame:
    """The peer join runs first: its output keeps no order the history window needs,
    and the two history columns then share one sort."""
    return history_weeks_used(own_history_baseline(peer_baseline(weekly))).select(*BASELINE_COLUMNS)


def baseline_reconciliation(weekly: DataFrame, baselines: DataFrame) -> DataFrame:
    """Derive every baseline a second way and compare, one row of counters.

    History by a self-join on the observation number instead of a frame, peers by
    an aggregate of the other routes instead of a subtraction where that is exact.
    """
    require_columns(baselines, BASELINE_COLUMNS)
    numbered = weekly.select(
        *KEY, "cost_per_tonne_km", F.row_number().over(history_window()).alias("n"))
    earlier = numbered.select(
        "route", "route_type", F.col("cost_per_tonne_km").alias("past"),
        F.explode(F.sequence(F.col("n") + 1, F.col("n") + HISTORY_WEEKS)).alias("n"))
    history = (
        numbered.join(earlier, ["route", "route_type", "n"], "left")
        .groupBy(*KEY)
        .agg(F.avg("past").alias("own2"), F.count("past").alias("used2")))
    peers = weekly.groupBy("route_type", "week_of").agg(
        F.sum("cost_per_tonne_km").alias("s"), F.count(F.lit(1)).alias("c"))
    own, peer = (F.col(c) for c in ("own_history_avg_cost_per_tonne_km",
                                    "similar_routes_avg_cost_per_tonne_km"))
    both = baselines.join(history, list(KEY), "left").join(peers, ["route_type", "week_of"], "left")
    peer2 = (F.col("s") - F.col("cost_per_tonne_km")) / F.nullif(F.col("c") - 1, F.lit(0))
    same = lambda a, b: (a.isNull() & b.isNull()) | close(a, b, 1e-9, 1e-12)
    counts = both.agg(
        failures(F.col("history_weeks_used") == F.col("used2")).alias("history_count"),
        failures(same(own, F.col("own2"))).alias("own_value"),
        failures(own.isNull() == (F.col("history_weeks_used") == 0)).alias("own_availability"),
        failures(F.col("peer_routes_used") == F.col("c") - 1).alias("peer_count"),
        failures(same(peer, peer2)).alias("peer_value"),
        failures(peer.isNull() == (F.col("peer_routes_used") == 0)).alias("peer_availability"),
    )
    rows = weekly.agg(F.count(F.lit(1)).alias("a")).join(baselines.agg(F.count(F.lit(1)).alias("b")))
    return check_table(counts.join(rows.select((F.col("a") != F.col("b")).cast("long").alias("row_count"))))


def baseline_summary(baselines: DataFrame) -> DataFrame:
    own, peer = (F.col(c) for c in ("own_history_avg_cost_per_tonne_km",
                                    "similar_routes_avg_cost_per_tonne_km"))
    return baselines.agg(
        F.count(F.lit(1)).alias("route_weeks"),
        F.count(own).alias("history_available"), F.count_if(own.isNull()).alias("history_unavailable"),
        F.count_if(F.col("history_weeks_used") == HISTORY_WEEKS).alias("full_history"),
        F.count(peer).alias("peer_available"), F.count_if(peer.isNull()).alias("peer_unavailable"),
        F.min("peer_routes_used").alias("min_peers"), F.max("peer_routes_used").alias("max_peers"),
    )


def history_count_histogram(baselines: DataFrame) -> DataFrame:
    """Rows per history count and per peer count, in one pass."""
    kinds = F.array(
        F.struct(F.lit("history").alias("kind"), F.col("history_weeks_used").alias("used")),
        F.struct(F.lit("peer").alias("kind"), F.col("peer_routes_used").alias("used")))
    return baselines.select(F.inline(kinds)).groupBy("kind", "used").agg(
        F.count(F.lit(1)).alias("route_weeks"))
