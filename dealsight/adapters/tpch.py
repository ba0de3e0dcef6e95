"""Domain tables carried on the star-schema test tables.

Each view is portable SQL over the raw tables, written once: Spark runs it to
feed the operators, and the check queries embed the same text as CTEs.  Only
the mapping is shared; the operators and the check queries are separate.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region nation customer supplier part orders lineitem events documents "
       "embeddings pages benchmark labels conversations").split()

DEAL_AS_OF = "2001-12-01 00:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"

AREAS = ["oncology", "immunology", "neurology", "rare_disease", "cardiovascular", "metabolic"]
PHASES = ["preclinical", "phase_1", "phase_2", "phase_3", "nda_bla", "approved"]


def pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"(CASE {expr} {arms} ELSE '{values[-1]}' END)"


_AREA_OF_TYPE = ("(CASE p_type WHEN 'ECONOMY' THEN 'oncology' WHEN 'LARGE' THEN 'immunology' "
                 "WHEN 'MEDIUM' THEN 'neurology' WHEN 'PROMO' THEN 'rare_disease' "
                 "WHEN 'SMALL' THEN 'cardiovascular' ELSE 'metabolic' END)")
_BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INT)"
_NS = "(SELECT count(*) FROM {supplier})"
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

VIEWS: dict[str, str] = {
    # drug programmes: one per part, owned by one supplier
    "d_assets": f"""
        SELECT p_partkey AS asset_id, p_partkey % {_NS} AS company_id, p_name AS asset_name,
               {_AREA_OF_TYPE} AS area, (p_size - 1) % 6 AS phase_rank,
               {pick('(p_size - 1) % 6', PHASES)} AS phase,
               split_part(p_name, ' ', 2) AS indication, split_part(p_name, ' ', 1) AS mechanism,
               {_BRAND} AS brand_no, p_size AS size_no,
               CAST(p_size * p_size * {_BRAND} * 50 AS BIGINT) AS patient_population,
               {_BRAND} % 5 = 0 AS orphan, {_BRAND} % 7 = 0 AS breakthrough,
               {_BRAND} % 3 = 0 AS fast_track, {_BRAND} % 4 = 0 AS priority_review,
               p_size > 4 AS is_active,
               TIMESTAMP '2001-12-01 00:00:00' - INTERVAL '1' DAY * ({_BRAND} * 4) AS last_update,
               p_retailprice * 1e6 AS peak_sales
        FROM {{part}}""",
    "d_supplied": """
        SELECT l_suppkey AS company_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
               sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
        FROM {lineitem} GROUP BY l_suppkey""",
    "d_focus": """
        SELECT company_id, array_sort(array_agg(area)) AS areas
        FROM (SELECT company_id, area FROM {d_assets} GROUP BY company_id, area HAVING count(*) >= 4) x
        GROUP BY company_id""",
    "d_lead": """
        SELECT company_id, count(*) AS n_assets, max(phase_rank) AS lead_rank,
               max_by(asset_name, phase_rank * 1000000000000 + asset_id) AS lead_asset,
               max_by(phase, phase_rank * 1000000000000 + asset_id) AS lead_phase,
               max_by(area, phase_rank * 1000000000000 + asset_id) AS lead_area,
               sum(CAST(peak_sales AS DECIMAL(24,2))) AS potential
        FROM {d_assets} GROUP BY company_id""",
    "d_companies": """
        SELECT s_suppkey AS company_id, 'T' || CAST(s_suppkey AS STRING) AS ticker, s_name AS name,
               n_name AS country,
               CASE r_name WHEN 'AMERICA' THEN 'North America' WHEN 'EUROPE' THEN 'Europe'
                           WHEN 'ASIA' THEN 'Asia' ELSE r_name END AS region,
               CAST(floor(CAST(coalesce(price, 0) AS DOUBLE) * (1 + abs(s_acctbal) / 100)) AS DOUBLE) AS market_cap,
               CAST(floor(abs(s_acctbal) * 30000) AS DOUBLE) AS cash,
               CASE WHEN s_nationkey % 7 = 0 THEN 0e0
                    ELSE CAST(floor(CAST(coalesce(qty, 0) AS DOUBLE) * 1500) AS DOUBLE) END AS quarterly_burn,
               CAST(floor(abs(s_acctbal) * 7500) * (s_nationkey % 5) AS DOUBLE) AS debt,
               s_nationkey AS nation_no, s_acctbal AS balance,
               f.areas AS areas, lead_area, lead_asset, lead_phase, coalesce(lead_rank, 0) AS lead_rank,
               coalesce(n_assets, 0) AS n_assets, CAST(potential AS DOUBLE) AS potential,
               (s_acctbal - 6000) / 60 AS stock_return_52w,
               0.1e0 + (s_suppkey % 10) / 10e0 AS institutional_ownership,
               s_nationkey % 11 = 0 AS is_royalty, s_nationkey % 4 = 0 AS is_platform,
               TIMESTAMP '2001-12-01 00:00:00' - INTERVAL '1' DAY * ((s_nationkey + 1) * 60) AS ipo_date,
               CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2001-06-01 00:00:00' ELSE NULL END AS deleted_at
        FROM {supplier}
        JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        LEFT JOIN {d_supplied} p ON p.company_id = s_suppkey
        LEFT JOIN {d_focus} f ON f.company_id = s_suppkey
        LEFT JOIN {d_lead} l ON l.company_id = s_suppkey""",
    # one past deal per order; two areas from the key
    "d_deals": f"""
        SELECT o_orderkey AS deal_id, o_custkey AS acquirer_id, o_orderkey % {_NS} AS target_id,
               o_orderdate AS deal_date, o_totalprice * 1e4 AS deal_value,
               o_totalprice * (2000 + (o_orderkey % 9) * 1000) AS target_market_cap,
               CAST((o_orderkey * 7) % 90 AS DOUBLE) AS premium,
               o_totalprice * 100 * (50 + o_orderkey % 51) AS upfront,
               {pick('o_orderkey % 6', AREAS)} AS area, {pick('(o_custkey + o_orderkey) % 6', AREAS)} AS area2,
               CASE WHEN o_custkey % 6 = 0 THEN split({pick('o_orderkey % 6', AREAS)}, ',')
                    ELSE split({pick('o_orderkey % 6', AREAS)} || ',' || {pick('(o_custkey + o_orderkey) % 6', AREAS)}, ',')
               END AS areas,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '2-HIGH' THEN 'phase_3'
                    WHEN '3-MEDIUM' THEN 'phase_2' WHEN '4-NOT SPECIFIED' THEN 'phase_1'
                    ELSE 'preclinical' END AS stage,
               CASE o_orderstatus WHEN 'F' THEN 'cash' WHEN 'O' THEN 'cash_and_cvr' ELSE 'stock' END AS structure
        FROM {{orders}}""",
    "d_buyer_areas": """
        SELECT acquirer_id, area, count(*) AS n FROM (
            SELECT acquirer_id, area FROM {d_deals}
            UNION ALL SELECT acquirer_id, area2 AS area FROM {d_deals} WHERE area2 <> area) x
        GROUP BY acquirer_id, area""",
    "d_buyer_focus": """
        SELECT acquirer_id, array_sort(array_agg(area)) AS areas FROM {d_buyer_areas} WHERE n >= 3 GROUP BY acquirer_id""",
    "d_buyer_gaps": """
        SELECT acquirer_id, array_sort(array_agg(area)) AS gaps FROM {d_buyer_areas} WHERE n = 2 GROUP BY acquirer_id""",
    "d_buyer_spend": """
        SELECT o_custkey AS acquirer_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend,
               sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-12-01 00:00:00'
                        THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS recent
        FROM {orders} GROUP BY o_custkey""",
    "d_acquirers": """
        SELECT c_custkey AS acquirer_id, c_name AS acquirer_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'big_pharma' WHEN 'BUILDING' THEN 'mid_pharma'
                    WHEN 'FURNITURE' THEN 'large_biotech' WHEN 'MACHINERY' THEN 'strategic_buyer'
                    ELSE 'private_equity' END AS acquirer_type,
               f.areas AS areas, g.gaps AS gaps, c_nationkey AS nation_no,
               CAST(coalesce(spend, 0) AS DOUBLE) * 1000 AS market_cap,
               CAST(floor(abs(c_acctbal) * 200000) AS DOUBLE) AS cash,
               CAST(floor(abs(c_acctbal) * 30000) * (c_nationkey % 8) AS DOUBLE) AS debt,
               CAST(coalesce(recent, 0) AS DOUBLE) * 400 AS recent_spend,
               c_acctbal > 0 AS is_active
        FROM {customer} LEFT JOIN {d_buyer_focus} f ON f.acquirer_id = c_custkey
        LEFT JOIN {d_buyer_gaps} g ON g.acquirer_id = c_custkey
        LEFT JOIN {d_buyer_spend} s ON s.acquirer_id = c_custkey""",
    # one patent per order line; a family is one order
    "d_patents": """
        SELECT l_orderkey * 10 + l_linenumber AS patent_id, l_suppkey AS company_id, l_orderkey AS family_id,
               l_partkey AS asset_id, l_shipdate + INTERVAL '1' YEAR * (l_linenumber * 3) AS expiry_date,
               CAST(l_quantity AS INT) AS claims_count, CAST(round(l_tax * 100) AS INT) AS citations_count,
               l_returnflag = 'A' AS is_composition, l_returnflag = 'N' AS is_method,
               l_returnflag = 'R' AS is_formulation, l_discount AS discount
        FROM {lineitem}""",
    "d_cliffs": f"""
        SELECT o_custkey AS acquirer_id, l_partkey AS drug_id, l_orderkey * 10 + l_linenumber AS cliff_id,
               p_name AS drug_name, {_AREA_OF_TYPE} AS area, l_extendedprice * 1e4 AS annual_revenue,
               l_shipdate + INTERVAL '1' YEAR * 5 AS expiry_date
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
    # typed signals: one per event
    "d_signals": f"""
        SELECT event_id AS signal_id, user_id % {_NS} AS company_id, ts AS event_date, event_type AS source_type,
               CASE event_type WHEN 'view' THEN 'clinical_trial' WHEN 'click' THEN 'patent'
                    WHEN 'purchase' THEN 'insider_transaction' WHEN 'signup' THEN 'hiring'
                    ELSE 'financial' END AS signal_type,
               CASE WHEN value < 15 THEN 'low' WHEN value < 40 THEN 'medium' WHEN value < 100 THEN 'high'
                    ELSE 'critical' END AS severity,
               value, {_K} AS k, {_K} / 100e0 AS confidence, user_id
        FROM {{events}}""",
    "d_scores": """
        SELECT company_id, CAST(event_date AS DATE) AS score_date,
               least(100e0, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)) AS score,
               count(*) AS n_signals
        FROM {d_signals} GROUP BY company_id, CAST(event_date AS DATE)""",
    "d_financials": """
        SELECT l_suppkey AS company_id, date_trunc('quarter', l_shipdate) AS as_of_date,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 100 * (1 + l_suppkey % 20) AS market_cap,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 100000 AS cash,
               CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) * 4000000 AS burn_rate,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * (l_suppkey % 7) * 25 AS revenue,
               date_trunc('quarter', l_shipdate) + INTERVAL '1' DAY * ((l_suppkey % 40) * 30) AS next_catalyst_date
        FROM {lineitem} GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)""",
    "d_insider": """
        SELECT company_id, signal_id, event_date AS transaction_date,
               CASE WHEN k % 3 = 0 THEN 'purchase' ELSE 'sale' END AS transaction_type,
               value * 20000 AS amount, k % 4 = 0 AS is_executive, k % 5 = 0 AS is_planned
        FROM {d_signals} WHERE source_type = 'purchase'""",
    "d_holdings": """
        SELECT company_id, signal_id, event_date AS filing_date, value - 60 AS position_change_pct, k % 4 = 0 AS is_activist
        FROM {d_signals} WHERE source_type = 'signup'""",
    "d_regulator": """
        SELECT company_id, signal_id, event_date AS interaction_date,
               CASE k % 3 WHEN 0 THEN 'SPA' WHEN 1 THEN 'Type B meeting' ELSE 'written response' END AS interaction_type,
               CASE k % 7 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Agreement reached' WHEN 2 THEN 'Complete Response letter'
                    ELSE 'pending' END AS outcome
        FROM {d_signals} WHERE source_type = 'click'""",
    "d_issues": """
        SELECT company_id, signal_id, event_date AS issue_date,
               CASE k % 25 WHEN 0 THEN 'clinical_hold' WHEN 1 THEN 'warning_letter' ELSE 'other' END AS issue_type
        FROM {d_signals} WHERE source_type = 'error'""",
    # the wide per-type signal record; attributes come from the event's own fields
    "d_wide": f"""
        SELECT signal_id, company_id, event_date, signal_type, confidence, k / 10e0 AS relevance,
               {pick('k % 6', ['phase_1', 'phase_1_2', 'phase_2', 'phase_2_3', 'phase_3', 'phase_4'])} AS phase,
               {pick('k % 5', ['positive', 'negative', 'mixed', 'pending', 'unknown'])} AS outcome,
               k % 2 = 0 AS endpoint_met, {pick('k % 3', ['completed', 'recruiting', 'active'])} AS status,
               event_date + INTERVAL '1' DAY * (k * 40) AS expiry_date,
               k % 2 = 1 AS is_composition, k % 3 = 0 AS is_method, k % 5 = 0 AS is_formulation,
               k % 4 = 0 AS litigation, k % 3 AS drugs_covered,
               {pick('k % 7', ['ceo', 'cfo', 'director', 'cso', 'officer', 'cmo', 'other'])} AS insider_role,
               {pick('k % 3', ['purchase', 'sale', 'gift'])} AS transaction_type, k % 4 = 1 AS is_planned,
               value * 100 AS shares, 10 + k / 4e0 AS price,
               {pick('k % 4', ['VP Corporate Development', 'Chemist', 'Head of BD', 'Analyst'])} AS role,
               {pick('k % 4', ['vp', 'individual_contributor', 'c_suite', 'manager'])} AS seniority,
               k % 2 = 0 AS is_new_position, {pick('k % 3', ['Big Pharma Inc', 'Widget Co', 'Acme Therapeutics'])} AS previous_company,
               value * 1000000 AS cash, (k % 10) * 1e7 AS quarterly_burn,
               k % 9 = 0 AS going_concern, k % 11 = 0 AS covenant_breach, k % 8 = 0 AS guidance_lowered
        FROM {{d_signals}}""",
    "d_latest": """
        SELECT company_id, max_by(score, score_date) AS ma_score, max(score_date) AS score_date FROM {d_scores} GROUP BY company_id""",
    # screening universe: area and stage names of the screening vocabulary
    "d_hot_areas": """
        SELECT company_id, array_sort(array_agg(area)) AS hot_areas, min(area) AS first_area FROM (
          SELECT company_id, CASE area WHEN 'oncology' THEN 'oncology_adc' WHEN 'neurology' THEN 'cns_neuropsychiatry'
                 WHEN 'metabolic' THEN 'obesity_glp1' ELSE area END AS area
          FROM {d_assets} GROUP BY company_id, area HAVING count(*) >= 4) x GROUP BY company_id""",
    "d_universe": f"""
        SELECT c.company_id AS company_id, ticker, name, market_cap, cash AS cash_position, quarterly_burn AS quarterly_burn_rate,
               lead_asset, lead_rank, {pick('lead_rank', ['Preclinical', 'Phase 1', 'Phase 2', 'Phase 3', 'NDA/BLA Filed', 'Approved'])} AS lead_asset_phase,
               n_assets AS total_assets, h.hot_areas AS therapeutic_areas, h.first_area AS first_area, region, stock_return_52w,
               institutional_ownership, is_royalty, is_platform, ipo_date, nation_no,
               nation_no % 3 = 0 AS has_activist_investor, nation_no % 5 = 0 AS has_takeover_rumors
        FROM {{d_companies}} c LEFT JOIN {{d_hot_areas}} h ON h.company_id = c.company_id""",
    # programmes a buyer holds: the parts on its returned-and-closed order lines
    "d_licensed": f"""
        SELECT o_custkey AS acquirer_id, p_partkey AS asset_id, {_AREA_OF_TYPE} AS area,
               {pick('(p_size - 1) % 6', PHASES)} AS phase, p_retailprice * 1e6 AS peak_sales
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey
        WHERE l_returnflag = 'A'""",
    "d_losses": """
        SELECT c.acquirer_id AS acquirer_id, c.cliff_id AS cliff_id, c.drug_name AS product, c.area AS area,
               c.annual_revenue / 1e6 AS annual_revenue, c.expiry_date AS expiry_date,
               CAST((c.drug_id * 7) % 101 AS DOUBLE) AS generic_risk, c.drug_id % 3 = 0 AS replaced, r.total_revenue AS total_revenue
        FROM {d_cliffs} c JOIN (SELECT acquirer_id, CAST(sum(CAST(annual_revenue AS DECIMAL(24,2))) AS DOUBLE) / 6e6 AS total_revenue
                                FROM {d_cliffs} GROUP BY acquirer_id) r ON r.acquirer_id = c.acquirer_id""",
    "d_bidders": """
        SELECT a.acquirer_id AS acquirer_id, acquirer_name, areas, is_active,
               least(100e0, 20e0 + 30e0 * coalesce(g.n, 0)) AS gap_severity,
               CASE WHEN coalesce(g.n, 0) >= 3 THEN 'critical' WHEN coalesce(g.n, 0) = 2 THEN 'high'
                    WHEN coalesce(g.n, 0) = 1 THEN 'medium' ELSE 'low' END AS urgency,
               CASE nation_no % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'moderate' ELSE 'conservative' END AS bidding,
               nation_no % 4 = 0 AS cliff_risk, CAST(nation_no * 4 AS DOUBLE) AS concentration,
               coalesce(g.n, 0) + nation_no % 3 AS recent_deals, market_cap, cash, debt, recent_spend
        FROM {d_acquirers} a LEFT JOIN (SELECT acquirer_id, count(*) AS n FROM {d_buyer_areas} WHERE n = 2 GROUP BY acquirer_id) g
          ON g.acquirer_id = a.acquirer_id""",
    # market = area and brand; shares in percent of the market's sales
    "d_shares": """
        SELECT market, company_id, sales, 100e0 * sales / sum(sales) OVER (PARTITION BY market) AS share
        FROM (SELECT area || ':' || CAST(brand_no AS STRING) AS market, company_id,
                     CAST(sum(CAST(peak_sales AS DECIMAL(24,2))) AS DOUBLE) AS sales
              FROM {d_assets} GROUP BY area || ':' || CAST(brand_no AS STRING), company_id) x""",
    "d_proposals": f"""
        SELECT o_orderkey AS deal_id, o_custkey % {_NS} AS buyer_id, o_orderkey % {_NS} AS target_id, o_custkey AS acquirer_id,
               o_totalprice / 40 AS deal_value_mm, o_orderkey % 5 AS overlap_areas
        FROM {{orders}}""",
    "d_reviews": """
        SELECT o_custkey AS acquirer_id, count(*) AS reviewed, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS blocked,
               sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS remedies,
               sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END) AS second_requests,
               sum(CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' AND o_orderstatus = 'P' THEN 1 ELSE 0 END) AS challenges,
               o_custkey % 9 = 0 AS decree
        FROM {orders} GROUP BY o_custkey""",
    # clinical profile of each programme
    "d_clinical": f"""
        SELECT p_partkey AS asset_id, {_AREA_OF_TYPE} || ':' || split_part(p_name, ' ', 2) AS drug_class,
               CASE WHEN p_size % 7 = 0 THEN 'obesity' ELSE split_part(p_name, ' ', 2) END AS indication,
               {pick('p_size % 8', ['once_monthly', 'twice_monthly', 'once_weekly', 'twice_weekly', 'once_daily', 'twice_daily', 'three_times_daily', 'as_needed'])} AS dosing,
               {pick(_BRAND + ' % 7', ['oral', 'subcutaneous', 'transdermal', 'inhaled', 'intramuscular', 'intravenous', 'other'])} AS route,
               {pick('(p_size + ' + _BRAND + ') % 4', ['first_in_class', 'best_in_class', 'fast_follower', 'me_too'])} AS novelty,
               p_partkey % 3 <> 0 AS endpoint_met, CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS endpoint_value,
               (p_partkey % 13) * (p_partkey % 13) * 5e-4 AS p_value, (p_partkey % 12) / 10e0 AS effect,
               CAST((p_partkey * 7) % 100 AS DOUBLE) AS ae_rate, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % 25 AS DOUBLE) END AS serious_rate,
               CAST((p_partkey * 3) % 40 AS DOUBLE) AS stop_rate, p_partkey % 4 = 0 AS head_to_head, p_partkey % 8 = 0 AS superior,
               CAST(p_partkey % 40 AS DOUBLE) AS efficacy_delta, p_size % 3 = 0 AS new_formulation, p_size % 5 = 0 AS new_delivery,
               {_BRAND} % 6 = 0 AS formulation_patent, CAST(p_partkey % 11 AS DOUBLE) AS patient_pref, CAST(p_partkey % 9 AS DOUBLE) AS physician_pref
        FROM {{part}}""",
    "d_premium": f"""
        SELECT o_orderkey AS deal_id, CAST((o_orderkey * 13) % 101 AS DOUBLE) AS clinical, CAST((o_custkey * 7 + o_orderkey) % 101 AS DOUBLE) AS momentum,
               CAST((o_orderkey * 3 + o_custkey) % 101 AS DOUBLE) AS tension, CAST((o_custkey * 11) % 101 AS DOUBLE) AS antitrust,
               CAST((o_orderkey * 5) % 101 AS DOUBLE) AS gap_fit, o_totalprice / 100 AS cap_mm, o_totalprice * (o_orderkey % 9) / 1000 AS cash_mm,
               {pick('o_orderkey % 6', ['Preclinical', 'Phase 1', 'Phase 2', 'Phase 3', 'NDA/BLA Filed', 'Approved'])} AS stage
        FROM {{orders}}""",
    # market snapshot, news, conference and social rows: one per event of a type
    "d_market": f"""
        SELECT signal_id, company_id AS ticker, event_date AS ts, value / 30 AS volume_anomaly, (k - 50) / 2e0 AS short_change,
               {pick('k % 5', ['heavy_call_buying', 'call_spread', 'protective_puts', 'normal', 'unusual_activity'])} AS options_activity,
               (k % 30) / 10e0 AS call_put, k % 5 AS upgrades, k % 3 AS downgrades, CAST(k % 40 - 10 AS DOUBLE) AS target_change,
               CAST(k % 16 - 6 AS DOUBLE) AS accumulation, CAST(k % 11 AS DOUBLE) AS insider, CAST(k % 60 - 25 AS DOUBLE) AS momentum_20d,
               CAST(k % 80 - 30 AS DOUBLE) AS momentum_60d
        FROM {{d_signals}}""",
    "d_news": """
        SELECT signal_id, company_id AS ticker, event_date AS published, (k - 50) / 50e0 AS sentiment, least(1e0, value / 100) AS relevance
        FROM {d_signals} WHERE source_type = 'view'""",
    "d_conf": f"""
        SELECT signal_id, company_id AS ticker, event_date AS held, {pick('k % 5', ['keynote', 'oral', 'panel', 'poster', 'demo'])} AS presentation,
               {pick('k % 4', ['breakthrough', 'positive', 'neutral', 'disappointing'])} AS quality, CAST(k % 10 AS DOUBLE) AS buzz
        FROM {{d_signals}} WHERE source_type = 'signup'""",
    "d_social": """
        SELECT signal_id, company_id AS ticker, event_date AS ts, (k - 40) / 60e0 AS sentiment, value / 10 AS engagement,
               k % 6 = 0 AS trending, k AS mentions
        FROM {d_signals} WHERE source_type = 'click'""",
    "d_trials": f"""
        SELECT l_orderkey AS trial_id, {_AREA_OF_TYPE} AS area, {pick('(p_size - 1) % 4', ['Phase 1', 'Phase 2', 'Phase 3', 'Phase 4'])} AS phase,
               l_shipdate AS start_date, l_suppkey AS sponsor, l_quantity * 20 AS enrollment,
               CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'terminated' ELSE 'recruiting' END AS status
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "d_drugs": f"""
        SELECT p_partkey AS drug_id, p_partkey % {_NS} AS company_id, p_name AS drug_name, p_retailprice * 1e6 AS peak_sales,
               {pick('(p_size - 1) % 6', ['Preclinical', 'Phase 1', 'Phase 2', 'Phase 3', 'NDA Filed', 'Approved'])} AS phase,
               (CASE p_type WHEN 'ECONOMY' THEN 'Oncology Solid Tumors' WHEN 'LARGE' THEN 'Immunology' WHEN 'MEDIUM' THEN 'CNS'
                     WHEN 'PROMO' THEN 'Rare Disease' WHEN 'SMALL' THEN 'Cardiovascular' ELSE 'Obesity/Metabolic' END) AS area,
               {pick(_BRAND + ' % 5', ['standard', 'blockbuster', 'orphan', 'fast_follower', 'gene_therapy'])} AS curve,
               p_size % 5 AS years_to_launch, 6 + p_size % 12 AS patent_life,
               {pick('p_partkey % 5', ['first_in_class', 'best_in_class', 'competitive', 'me_too', 'orphan_dominant'])} AS position
        FROM {{part}}""",
    # labelled outcomes with three document features as factors
    "d_outcomes": """
        SELECT l.doc_id AS doc_id, quality AS outcome, source AS period, lang AS segment,
               least(100e0, n_chars / 60e0) AS f_length,
               100e0 * (1 - least(1e0, (length(text) - length(replace(text, ' ', ''))) / (n_chars * 0.25e0 + 1))) AS f_density,
               least(100e0, (length(text) - length(replace(text, 'e', ''))) * 500e0 / (n_chars + 1)) AS f_letter
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    # management signals and pair inputs of the eight-factor rules
    "d_management": f"""
        SELECT signal_id, company_id, event_date,
               {pick('k % 10', ['ceo_cfo_departure', 'board_addition', 'activist', 'advisor_hired', 'strategic_review', 'insider_buying', 'key_hire', 'rd_reduction', 'asset_sale', 'programme_end'])} AS kind,
               value < 20 AS weak
        FROM {{d_signals}} WHERE severity = 'critical' OR severity = 'low'""",
    "d_pair_inputs": f"""
        SELECT o_orderkey AS deal_id, {pick('o_custkey % 5', ['high', 'medium', 'low', 'adjacent', 'none'])} AS priority,
               {pick('o_orderkey % 3', ['match', 'complementary', 'none'])} AS technology, CAST(o_orderkey % 80 AS INT) AS months_to_cliff,
               CAST((o_custkey * 3) % 60 AS INT) AS months_to_approval, {pick('(o_orderkey + o_custkey) % 4', ['indication', 'area', 'related', 'unrelated'])} AS cliff_match,
               (o_totalprice / 500000) AS sales_ratio, (o_totalprice % 7000) / 1000 AS size_ratio, 0.2e0 + (o_custkey % 20) / 10e0 AS funding_ratio,
               {pick('o_orderkey % 4', ['preferred', 'adjacent', 'acceptable', 'other'])} AS stage_match, {pick('(o_custkey + 1) % 4', ['phase_3_positive', 'phase_2_strong', 'phase_2_early', 'earlier'])} AS data_state,
               CAST(o_custkey % 7 AS INT) AS deals_in_area, CAST(o_orderkey % 5 AS INT) AS deals_at_stage, CAST(o_custkey % 8 AS INT) - 3 AS product_gap,
               CAST((o_orderkey % 30) AS DOUBLE) - 15 AS revenue_growth, {pick('o_orderkey % 4', ['launched', 'phase_3', 'erosion', 'stable'])} AS threat,
               CAST(o_totalprice % 100 AS DOUBLE) AS target_score, CAST(o_orderkey % 5 AS INT) AS strong_80, CAST(o_custkey % 4 AS INT) AS strong_70,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 24 AS INT) END AS months_to_catalyst, o_custkey % 2 = 0 AS low_runway
        FROM {{orders}}""",
    "d_prices": """
        SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
                 / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
        FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)""",
}


def _deps(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Lazy access: ``t.lineitem`` is raw, ``t.companies`` is the domain view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir.rstrip("/"), {}

    def get(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in RAW:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = VIEWS[name]
                df = self.spark.sql(sql, **{d: self.get(d) for d in _deps(sql)})
            self._seen[name] = df
        return self._seen[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name if name in RAW else f"d_{name}")


def with_views(sql: str) -> str:
    """Prefix a check query with the CTEs of every ``d_*`` view it names."""
    order: list[str] = []

    def need(text: str):
        for name in dict.fromkeys(re.findall(r"\bd_\w+\b", text)):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"WITH RECURSIVE {ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
