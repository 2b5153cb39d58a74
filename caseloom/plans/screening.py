"""Queries of the screening operators over deals made of orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import screening as S
from caseloom.plans.catalog import with_
from caseloom.sources.adapters import table

QUERIES, ORACLES = {}, {}

#: Rules for the queries. rule, test, condition, metric, scope, party, op, value, currency, q_count, q_set, pending
CONDITIONS = [
    ("eu", "t1", "c1", "revenue", "worldwide", "combined", ">", 9.0e6, "EUR", None, None, False),
    ("eu", "t1", "c2", "revenue", "eu_eea", "each_of_at_least_two", ">", 1.5e6, "EUR", None, None, False),
    ("eu", "t2", "c3", "revenue", "worldwide", "combined", ">", 6.0e6, "EUR", None, None, False),
    ("eu", "t2", "c4", "revenue", "worldwide", "combined", ">", 0.9e6, "EUR", 3, "eu_member_states", False),
    ("uk", "t1", "c1", "revenue", "uk", "target_group", ">", 0.6e6, "GBP", None, None, False),
    ("uk", "t2", "c2", "market_share", "uk", "combined", ">=", 25.0, "GBP", None, None, False),
    ("uk", "t3", "c3", "revenue", "worldwide", "combined", ">", 1.0, "GBP", None, None, True),
    ("us", "t1", "c1", "deal_value", "worldwide", "combined", ">", 2.0e5, "USD", None, None, False),
    ("us", "t1", "c2", "revenue_or_assets", "worldwide", "either_party", ">=", 5.0e6, "USD", None, None, False),
    ("us", "t2", "c3", "assets", "worldwide", "combined", ">", 7.0e6, "USD", None, None, False),
    ("de", "t1", "c1", "revenue", "domestic", "either_party", ">", 1.0e6, "EUR", None, None, False),
    ("de", "t1", "c2", "revenue", "worldwide", "acquirer_group", "<=", 9.5e6, "EUR", None, None, False),
    ("fr", "t1", "c1", "incremental_share", "fr", "combined", ">=", 5.0, "EUR", None, None, False),
    ("fr", "t1", "c2", "revenue", "worldwide", "each_party", ">", 1.0e6, "EUR", 2, "all", False),
    ("jp", "t1", "c1", "revenue", "worldwide", "target_group", ">", 1.0, "JPY", None, None, True),
]
RULES = [
    ("eu", [], None, ["Simplified procedure may apply."]),
    ("uk", ["full_merger", "minority_stake"], (True, "material_influence", []), ["Voluntary regime.", "Share of supply test."]),
    ("us", ["full_merger", "minority_stake", "joint_venture"], (True, "percentage_based", [("any", ">", 30.0), ("non_horizontal", ">=", 15.0)]), []),
    ("de", ["full_merger", "minority_stake"], (True, "percentage_based", [("horizontal", ">=", 25.0)]), None),
    ("fr", ["full_merger", "joint_venture"], (True, "control_based", []), []),
    ("jp", [], (False, "none", []), []),
]


def conditions(spark):
    return spark.createDataFrame(CONDITIONS, "rule_id string, test_id string, condition_id string, metric string, scope string, party string, op string, value double, currency string, q_count int, q_set string, pending boolean")


def rules(spark):
    return spark.createDataFrame(RULES, "rule_id string, triggers array<string>, minority struct<applies:boolean,standard:string,rules:array<struct<relation:string,op:string,pct:double>>>, notes array<string>")


def deals(spark, sf):
    """A deal per order: the customer acquires a supplier; figures follow their balances and nations."""
    o, c, s = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    d = o.join(c, o.o_custkey == c.c_custkey).join(s, F.col("o_orderkey") % 10 == F.col("s_suppkey"))
    return d.selectExpr(
        "o_orderkey AS deal_id",
        *[
            f"""map_filter(map('worldwide', {x} * 1000D, 'eu_eea', if({n} % 2 = 0, {x} * 400D, null), 'uk', if({n} % 3 = 0, {x} * 100D, null)), (k, v) -> v is not null) AS {side}"""
            for side, x, n in (("acquirer", "c_acctbal", "c_nationkey"), ("target", "s_acctbal", "s_nationkey"))
        ],
        *[
            f"""map_filter(map('DE', {x} * 200D, 'FR', if({n} % 2 = 1, {x} * 150D, null), 'IT', {x} * 90D, 'CH', if({n} % 5 = 0, {x} * 300D, null)), (k, v) -> v is not null) AS {side}_countries"""
            for side, x, n in (("acquirer", "c_acctbal", "c_nationkey"), ("target", "s_acctbal", "s_nationkey"))
        ],
        "if(o_orderkey % 3 = 0, null, c_acctbal * 500D) AS acquirer_assets",
        "if(o_orderkey % 4 = 0, null, s_acctbal * 500D) AS target_assets",
        "if(c_nationkey % 2 = 0, map('de', c_acctbal * 70D), map()) AS acquirer_assets_countries",
        "if(s_nationkey % 2 = 0, map('fr', s_acctbal * 60D), map()) AS target_assets_countries",
        "if(o_orderkey % 7 = 0, null, o_totalprice) AS deal_value",
        "'EUR' AS deal_currency",
        "'EUR' AS revenue_currency",
        "map('USD', 1.1D, 'GBP', 0.85D) AS fx_rates",
        "if(o_orderkey % 5 = 0, map('uk', cast(o_orderkey % 60 AS double)), map()) AS combined_share",
        "cast(map() AS map<string, double>) AS acquirer_share",
        "map('fr', cast(o_orderkey % 11 AS double)) AS incremental_share",
        "case o_orderstatus when 'F' then 'full_merger' when 'O' then 'minority_stake' end AS deal_type",
        "if(o_orderkey % 6 = 0, 'no_control', 'sole_control') AS control",
        "case o_orderkey % 4 when 0 then 'horizontal' when 1 then 'vertical' when 2 then 'conglomerate' end AS relation",
        "if(o_orderkey % 9 = 0, null, cast(o_orderkey % 50 AS double)) AS pct_shares",
    )


def _v(x) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else text(x) if isinstance(x, str) else repr(x) + "::DOUBLE" if isinstance(x, float) else repr(x)


COND_SQL = "cond(rule_id, test_id, condition_id, metric, scope, party, op, value, currency, q_count, q_set, pending) AS (VALUES " + ", ".join("(" + ", ".join(map(_v, r)) + ")" for r in CONDITIONS) + ")"

#: A deal's sides as plain columns.
DEALS_SQL = """deals AS (
    SELECT o_orderkey AS deal_id, c_acctbal AS x, c_nationkey AS n, s_acctbal AS y, s_nationkey AS m,
           CASE WHEN o_orderkey % 3 <> 0 THEN c_acctbal * 500 END AS aa, CASE WHEN o_orderkey % 4 <> 0 THEN s_acctbal * 500 END AS ta,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS dv, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 60)::DOUBLE END AS uk_share,
           (o_orderkey % 11)::DOUBLE AS fr_inc, CASE o_orderstatus WHEN 'F' THEN 'full_merger' WHEN 'O' THEN 'minority_stake' END AS kind,
           CASE WHEN o_orderkey % 6 = 0 THEN 'no_control' ELSE 'sole_control' END AS control,
           CASE o_orderkey % 4 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' WHEN 2 THEN 'conglomerate' END AS relation,
           CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 50)::DOUBLE END AS pct
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON o_orderkey % 10 = s_suppkey)"""
MET_SQL = f"""{COND_SQL}, {DEALS_SQL},
sides AS (
    SELECT *, CASE currency WHEN 'USD' THEN 1.1 WHEN 'GBP' THEN 0.85 ELSE 1.0 END::DOUBLE AS fx,
           CASE scope WHEN 'worldwide' THEN x * 1000 WHEN 'eu_eea' THEN CASE WHEN n % 2 = 0 THEN x * 400 END WHEN 'uk' THEN CASE WHEN n % 3 = 0 THEN x * 100 END END AS a,
           CASE scope WHEN 'worldwide' THEN y * 1000 WHEN 'eu_eea' THEN CASE WHEN m % 2 = 0 THEN y * 400 END WHEN 'uk' THEN CASE WHEN m % 3 = 0 THEN y * 100 END END AS t
    FROM deals, cond),
countries AS (
    SELECT deal_id, k, coalesce(a, 0) AS a, coalesce(t, 0) AS t FROM (
        SELECT deal_id, unnest(['DE', 'FR', 'IT', 'CH']) AS k,
               unnest([x * 200, CASE WHEN n % 2 = 1 THEN x * 150 END, x * 90, CASE WHEN n % 5 = 0 THEN x * 300 END]) AS a,
               unnest([y * 200, CASE WHEN m % 2 = 1 THEN y * 150 END, y * 90, CASE WHEN m % 5 = 0 THEN y * 300 END]) AS t FROM deals)
    WHERE a IS NOT NULL OR t IS NOT NULL),
nth AS (
    SELECT deal_id, list(a + t ORDER BY a + t DESC) FILTER (k <> 'CH') AS eu_sum, list(least(a, t) ORDER BY least(a, t) DESC) AS all_min FROM countries GROUP BY 1),
vals AS (
    SELECT s.*, CASE
        WHEN q_count = 3 THEN eu_sum[least(3, len(eu_sum))] * fx
        WHEN q_count = 2 THEN all_min[least(2, len(all_min))] * fx
        WHEN metric = 'deal_value' THEN dv * fx
        WHEN metric = 'market_share' THEN uk_share
        WHEN metric = 'incremental_share' THEN CASE scope WHEN 'fr' THEN fr_inc END
        WHEN metric = 'assets' THEN CASE WHEN aa IS NOT NULL OR ta IS NOT NULL THEN (coalesce(aa, 0) + coalesce(ta, 0)) * fx END
        WHEN metric = 'revenue_or_assets' THEN greatest(a, aa, t, ta) * fx
        WHEN party = 'combined' THEN CASE WHEN a IS NOT NULL OR t IS NOT NULL THEN (coalesce(a, 0) + coalesce(t, 0)) * fx END
        WHEN party = 'acquirer_group' THEN a * fx WHEN party = 'target_group' THEN t * fx
        WHEN party = 'either_party' THEN greatest(a, t) * fx
        WHEN a IS NOT NULL AND t IS NOT NULL THEN least(a, t) * fx END AS actual
    FROM sides s JOIN nth USING (deal_id)),
met AS (
    SELECT *, CASE op WHEN '>' THEN actual > value WHEN '>=' THEN actual >= value WHEN '<' THEN actual < value WHEN '<=' THEN actual <= value END AS met FROM vals)"""
TESTS_SQL = MET_SQL + """,
tests AS (
    SELECT deal_id, rule_id, test_id, bool_or(pending) AS pending,
           CASE WHEN bool_or(pending) THEN NULL WHEN count(*) FILTER (NOT met) > 0 THEN FALSE WHEN count(*) FILTER (met IS NULL) > 0 THEN NULL ELSE TRUE END AS fired,
           count(*) FILTER (value > 0 AND abs(actual - value) / value < 0.1) > 0 AS near,
           count(*) FILTER (value > 0 AND abs(actual - value) / value < 0.1 AND NOT met) > 0 AS near_failed
    FROM met GROUP BY 1, 2, 3)"""
STATUS_SQL = TESTS_SQL + """,
active AS (SELECT deal_id, rule_id, count(*) FILTER (NOT pending) AS n, count(*) FILTER (NOT pending AND fired IS NULL) AS nulls,
                  count(*) FILTER (NOT pending AND fired) AS hits, coalesce(string_agg(test_id, ',' ORDER BY test_id) FILTER (NOT pending AND fired), '') AS triggered_by,
                  count(*) FILTER (NOT pending AND CASE WHEN fired THEN near ELSE near_failed END) > 0 AS close FROM tests GROUP BY 1, 2),
result AS (SELECT deal_id, rule_id, CASE WHEN n = 0 THEN 'not_triggered' WHEN nulls = n THEN 'data_insufficient' WHEN hits > 0 THEN 'triggered'
                  WHEN nulls > 0 THEN 'unclear' ELSE 'not_triggered' END AS status, triggered_by,
                  CASE WHEN nulls > 0 THEN 'medium' WHEN close THEN 'low' ELSE 'high' END AS confidence FROM active)"""
PREFILTER_SQL = f"""prefilter AS (
    SELECT deal_id, rule_id, o.confidence AS confidence, o.note AS note FROM (
        SELECT *, CASE
            WHEN kind IS NOT NULL AND list_contains(CASE rule_id WHEN 'fr' THEN ['minority_stake'] ELSE [] END, kind)
                THEN {{'confidence': 'high', 'note': printf({_v(S.NOTES["type"])}, kind, 'full_merger, joint_venture')}}
            WHEN NOT (coalesce(kind = 'minority_stake', FALSE) OR control = 'no_control') THEN NULL
            WHEN rule_id = 'jp' THEN {{'confidence': 'high', 'note': {_v(S.NOTES["minority"])}}}
            WHEN rule_id = 'uk' AND control = 'no_control' THEN {{'confidence': 'medium', 'note': {_v(S.NOTES["influence"])}}}
            WHEN rule_id = 'fr' AND control = 'no_control' THEN {{'confidence': 'high', 'note': {_v(S.NOTES["control"])}}}
            WHEN rule_id = 'us' AND pct IS NOT NULL AND NOT (pct > 30 OR (pct >= 15 AND (relation IS NULL OR relation IN ('vertical', 'conglomerate'))))
                THEN {{'confidence': 'high', 'note': printf({_v(S.NOTES["share"])}, pct, 'any >30.0%' || CASE WHEN relation IS NULL OR relation IN ('vertical', 'conglomerate') THEN ', non_horizontal >=15.0%' ELSE '' END)}}
            WHEN rule_id = 'de' AND coalesce(relation = 'horizontal', TRUE) AND pct < 25 THEN {{'confidence': 'high', 'note': printf({_v(S.NOTES["share"])}, pct, 'horizontal >=25.0%')}}
            WHEN rule_id = 'de' AND relation <> 'horizontal' THEN {{'confidence': 'high', 'note': {_v(S.NOTES["other"])}}} END AS o
        FROM deals, (SELECT unnest(['eu', 'uk', 'us', 'de', 'fr', 'jp']) AS rule_id)) WHERE o IS NOT NULL)"""
SCREEN_SQL = STATUS_SQL + ", " + PREFILTER_SQL + """,
screened AS (
    SELECT r.deal_id, r.rule_id, CASE WHEN p.confidence IS NULL THEN status ELSE 'not_triggered' END AS status,
           CASE WHEN p.confidence IS NULL THEN triggered_by ELSE '' END AS triggered_by, coalesce(p.confidence, r.confidence) AS confidence,
           coalesce(note, CASE r.rule_id WHEN 'eu' THEN 'Simplified procedure may apply.' WHEN 'uk' THEN 'Voluntary regime.|Share of supply test.' ELSE '' END) AS notes
    FROM result r LEFT JOIN prefilter p ON r.deal_id = p.deal_id AND r.rule_id = p.rule_id)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(with_(MET_SQL) + " SELECT deal_id, rule_id, test_id, condition_id, round(actual, 4) AS actual, met, round(value - actual, 4) AS gap FROM met")
def n09_condition_values(spark, sf):
    m = S.conditions_met(deals(spark, sf), conditions(spark))
    return m.select("deal_id", "rule_id", "test_id", "condition_id", F.round("actual", 4).alias("actual"), "met", F.round("gap", 4).alias("gap"))


@query(with_(MET_SQL) + """ SELECT rule_id, condition_id, CASE party WHEN 'acquirer_group' THEN 'acquirer' WHEN 'target_group' THEN 'target' WHEN 'each_of_at_least_two' THEN 'each party'
    WHEN 'each_party' THEN 'each party' ELSE party END || ' ' || CASE scope WHEN 'domestic' THEN 'in-country/domestic' WHEN 'eu_eea' THEN 'EU/EEA' WHEN 'uk' THEN 'UK' ELSE scope END || ' ' ||
    CASE metric WHEN 'deal_value' THEN 'deal value' WHEN 'revenue_or_assets' THEN 'revenue or assets' WHEN 'market_share' THEN 'market share' ELSE metric END AS missing,
    count(*) AS deals FROM met WHERE actual IS NULL GROUP BY ALL""")  # fmt: skip
def n11_missing_data(spark, sf):
    m = S.conditions_met(deals(spark, sf), conditions(spark)).where("missing is not null")
    return m.groupBy("rule_id", "condition_id", "missing").agg(F.count("*").alias("deals"))


@query(with_(MET_SQL) + " SELECT deal_id, condition_id, round(actual, 4) AS actual FROM met WHERE q_count IS NOT NULL")
def a18_nth_country_value(spark, sf):
    m = S.conditions_met(deals(spark, sf), conditions(spark).where("q_count is not null"))
    return m.select("deal_id", "condition_id", F.round("actual", 4).alias("actual"))


@query(with_(TESTS_SQL) + " SELECT deal_id, rule_id, test_id, fired FROM tests")
def a15_tests_fired(spark, sf):
    return S.deal_tests(deals(spark, sf), conditions(spark)).select("deal_id", "rule_id", "test_id", "fired")


@query(with_(STATUS_SQL) + " SELECT deal_id, rule_id, status, triggered_by, confidence FROM result")
def a16_rule_status(spark, sf):
    return S.deal_statuses(deals(spark, sf), conditions(spark))


@query(with_(DEALS_SQL, PREFILTER_SQL) + " SELECT deal_id, rule_id, confidence, note FROM prefilter")
def n12_scope_prefilter(spark, sf):
    return S.prefiltered(deals(spark, sf), rules(spark))


@query(with_(SCREEN_SQL) + " SELECT deal_id, rule_id, status, triggered_by, confidence, notes FROM screened")
def j14_screen_all(spark, sf):
    return S.screened(deals(spark, sf), conditions(spark), rules(spark)).withColumn("notes", F.array_join("notes", "|"))


@query(with_(SCREEN_SQL) + " SELECT deal_id, count(*) FILTER (status = 'triggered') AS filings, count(*) FILTER (status IN ('unclear', 'data_insufficient')) AS unclear FROM screened GROUP BY 1")
def a19_filing_counts(spark, sf):
    return S.filing_counts(deals(spark, sf), conditions(spark), rules(spark))


@query(with_(SCREEN_SQL) + """ SELECT deal_id, rule_id, status, triggered_by, confidence,
    CASE status WHEN 'triggered' THEN 0 WHEN 'unclear' THEN 1 WHEN 'data_insufficient' THEN 2 ELSE 3 END::INT AS place FROM screened WHERE rule_id IN ('eu', 'us')""")  # fmt: skip
def k07_ranked_results(spark, sf):
    return S.ranked(S.screened(deals(spark, sf), conditions(spark), rules(spark)).drop("notes"), ["eu", "us"])


@query(with_(DEALS_SQL) + """, r AS (SELECT unnest(['de', 'fr']) AS rule_id)
    SELECT deal_id, rule_id, CASE rule_id WHEN 'de' THEN x * 200 ELSE CASE WHEN n % 2 = 1 THEN x * 150 END END AS acquirer_domestic,
           CASE rule_id WHEN 'de' THEN y * 200 ELSE CASE WHEN m % 2 = 1 THEN y * 150 END END AS target_domestic,
           CASE WHEN rule_id = 'de' AND n % 2 = 0 THEN x * 70 ELSE aa END AS acquirer_assets, CASE WHEN rule_id = 'fr' AND m % 2 = 0 THEN y * 60 ELSE ta END AS target_assets FROM deals, r""")  # fmt: skip
def j15_scoped_deals(spark, sf):
    d = S.scoped(deals(spark, sf), rules(spark).where("rule_id in ('de', 'fr')"))
    home = lambda side: F.try_element_at(side, F.lit("domestic")).alias(f"{side}_domestic")
    return d.select("deal_id", "rule_id", home("acquirer"), home("target"), "acquirer_assets", "target_assets")


@query(with_(SCREEN_SQL) + """ SELECT deal_id, rule_id, 'triggered' AS expected, status FROM screened WHERE rule_id = 'us' AND deal_id % 3 = 0 AND status <> 'triggered'""")
def g14_gold_mismatches(spark, sf):
    d = deals(spark, sf)
    gold = d.where("deal_id % 3 = 0").select("deal_id", F.lit("us").alias("rule_id"), F.lit("triggered").alias("expected"))
    return S.mismatches(S.screened(d, conditions(spark), rules(spark)), gold)
