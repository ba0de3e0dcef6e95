"""Benchmark: runs headline queries and prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from dealsight.adapters.tpch import Tables
from dealsight.operators import targets
from dealsight.plans import CATALOG
from dealsight.session import local_session

HEADLINE = ["composite_score", "screen_waterfall", "target_ranking", "universe_lookup", "acquirer_matching", "competitive_tension",
            "antitrust_risk", "momentum_score", "dcf_npv", "sensitivity_grid", "portfolio_valuation", "insider_component",
            "patent_component", "signal_strength_by_type", "percentile_ranks", "implied_valuation", "rescore_trigger",
            "related_events_30d", "event_dedup_hash", "news_near_dup", "form4_transactions", "digest_stats", "weekly_watchlist"]


HEAVY = ["patent_cliff_matches"]  # its result has a row for every cliff in every target's areas


def profiles(t: Tables):
    """One company profile per order: a universe large enough to time screening and ranking by rate."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    areas = F.array(*[F.lit(a) for a in targets.PRIORITY_AREAS])
    stages = F.array(*[F.lit(p) for p in targets.PHASE_RANK])
    return t.orders.select(
        k.alias("company_id"), F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.concat(F.lit("Company "), k.cast("string")).alias("name"),
        (price * 2e4).alias("market_cap"), (price * 2000).alias("cash_position"), (F.col("o_custkey") % 90 * 1e6).alias("quarterly_burn_rate"),
        F.lit("lead").alias("lead_asset"), (k % 6).cast("int").alias("lead_rank"), stages[(k % 6).cast("int")].alias("lead_asset_phase"),
        (k % 9).alias("total_assets"), F.array(areas[(k % 5).cast("int")]).alias("therapeutic_areas"), F.lit("Europe").alias("region"),
        (price / 3000 - 70).alias("stock_return_52w"), ((k % 10) / 10.0).alias("institutional_ownership"), F.lit(False).alias("is_royalty"),
        (k % 4 == 0).alias("is_platform"), F.lit(None).cast("timestamp").alias("ipo_date"), (k % 3 == 0).alias("has_activist_investor"),
        (k % 5 == 0).alias("has_takeover_rumors"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "dealsight-bench")
    headline = [q for q in HEADLINE if q in CATALOG]
    names = sys.argv[1:] or headline + [q for q in CATALOG if q not in headline and q not in HEAVY] + [q for q in HEAVY if q in CATALOG]
    budget = float(os.environ.get("BENCH_BUDGET_S", "420"))  # queries past the headline stop being started then
    CATALOG["digest_stats"].run(Tables(spark, sf_dir)).collect()  # warm up the session
    times, began = {}, time.time()
    for name in names:
        if name not in headline and time.time() - began > budget and not sys.argv[1:]:
            continue
        t0 = time.time()
        CATALOG[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    t0 = time.time()
    universe = profiles(Tables(spark, sf_dir))
    targets.identify_targets(universe, "2001-12-01 00:00:00", top_n=None).write.format("noop").mode("overwrite").save()
    rate = round(universe.count() / (time.time() - t0), 1)
    times["screen_and_rank_profiles"] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(t for q, t in times.items() if q in headline or q == "screen_and_rank_profiles" or sys.argv[1:]), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
                      "companies_per_sec_screen_and_rank": rate}))


if __name__ == "__main__":
    main()
