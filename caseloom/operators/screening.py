"""Screening deals against filing rules: values by metric, scope and party, three-valued tests, status and confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from caseloom.sources.scratch import kept

#: Member states by code.
EU_STATES = ["AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK"]

#: Order of statuses in a result list.
STATUS_ORDER = ["triggered", "unclear", "data_insufficient", "not_triggered"]

#: Rules meet deals in one broadcast; more conditions than this are refused.
MOST_CONDITIONS = 100_000


def rate(currency: Column, own: Column) -> Column:
    """Exchange rate to a rule's currency; 1 for the deal's own, and where none is given."""
    return F.when(own == currency, 1.0).otherwise(F.coalesce(F.try_element_at("fx_rates", currency), F.lit(1.0)))


def _revenue(a: Column, t: Column, party: Column) -> Column:
    both = F.when(a.isNotNull() | t.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(t, F.lit(0.0)))
    least = F.when(a.isNotNull() & t.isNotNull(), F.least(a, t))
    return (
        F.when(party == "combined", both)
        .when(party == "acquirer_group", a)
        .when(party == "target_group", t)
        .when(party == "either_party", F.greatest(a, t))
        .when(party.isin("each_party", "each_of_at_least_two"), least)
    )


def value_of(scope: Column, metric: Column, party: Column, currency: Column) -> Column:
    """What a deal has for a condition; null where the data lack.

    Combined treats one missing side as 0; each-party needs both, either-party one. Assets of each party are the acquirer's.
    """
    fx = rate(currency, F.col("revenue_currency"))
    a, t = F.try_element_at("acquirer", scope), F.try_element_at("target", scope)
    aa, ta = F.col("acquirer_assets"), F.col("target_assets")
    assets = _revenue(aa, ta, F.when(party == "each_party", "acquirer_group").when(party == "each_of_at_least_two", "none").otherwise(party))
    larger = _revenue(F.greatest(a, aa), F.greatest(t, ta), F.when(party.isin("each_party", "each_of_at_least_two"), "none").otherwise(party))
    share = F.when(party == "combined", F.try_element_at("combined_share", scope)).when(party.isin("acquirer_group", "each_party"), F.try_element_at("acquirer_share", scope))
    return (
        F.when(metric == "deal_value", F.col("deal_value") * rate(currency, F.col("deal_currency")))
        .when(metric == "market_share", share)
        .when(metric == "incremental_share", F.try_element_at("incremental_share", scope))
        .when(metric == "assets", assets * fx)
        .when(metric == "revenue_or_assets", larger * fx)
        .when(metric == "revenue", _revenue(a, t, party) * fx)
    )


def nth_country(metric: Column, party: Column, count: Column, country_set: Column, currency: Column) -> Column:
    """The count-th largest revenue by country (the smallest, if there are fewer); null if there is none or the metric is another."""
    a, t = F.col("acquirer_countries"), F.col("target_countries")
    every = F.array_union(F.map_keys(a), F.map_keys(t))
    keys = F.when(party == "acquirer_group", F.map_keys(a)).when(party == "target_group", F.map_keys(t)).when(party.isin("combined", "each_party", "each_of_at_least_two"), every)
    keys = F.when(country_set == "eu_member_states", F.array_intersect(keys, F.lit(EU_STATES))).otherwise(keys)
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    value = lambda k: (
        F.when(party == "combined", of(a, k) + of(t, k)).when(party == "acquirer_group", of(a, k)).when(party == "target_group", of(t, k)).otherwise(F.least(of(a, k), of(t, k)))
    )
    values = F.reverse(F.array_sort(F.transform(keys, value)))
    nth = F.get(values, F.least(count, F.size(values)) - 1)
    return F.when((metric == "revenue") & (F.size(values) > 0), nth * rate(currency, F.col("revenue_currency")))


def scoped(deals: DataFrame, rules: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Deals as each jurisdiction sees them: what is domestic comes from the country map where it is not given.

    Assets of a party in the rule's country (acquirer_assets_countries, target_assets_countries, where the deals have them) stand
    for its assets as a whole. zero_is_missing: the reading of expected results, where a zero stands for no data, and the uk and us figures are the domestic ones there.
    """
    ids = sorted(r.rule_id for r in rules.select("rule_id").distinct().limit(MOST_CONDITIONS).collect())
    d = deals.withColumn("rule_id", F.explode(F.lit(ids)))
    for side in ("acquirer", "target"):
        at = F.coalesce(F.try_element_at(f"{side}_countries", F.lower("rule_id")), F.try_element_at(f"{side}_countries", F.upper("rule_id")))
        own = F.try_element_at(side, F.lit("domestic"))
        if zero_is_missing:
            at, own = F.nullif(at, F.lit(0.0)), F.nullif(own, F.lit(0.0))
        home = F.coalesce(own, at)
        if zero_is_missing:
            rule = F.lower("rule_id")
            named = F.when(rule == "uk", F.try_element_at(side, F.lit("uk"))).when(rule.isin("us", "us_hsr"), F.try_element_at(side, F.lit("us")))
            home = F.coalesce(home, named)
        rest = F.map_filter(side, lambda k, v: k != "domestic")
        d = d.withColumn(side, F.when(home.isNotNull(), F.map_concat(rest, F.create_map(F.lit("domestic"), home))).otherwise(rest))
        if f"{side}_assets_countries" in deals.columns:
            d = d.withColumn(f"{side}_assets", F.coalesce(F.try_element_at(f"{side}_assets_countries", F.lower("rule_id")), f"{side}_assets"))
    return d


#: How missing data are named.
PARTY = {"acquirer_group": "acquirer", "target_group": "target", "each_of_at_least_two": "each party", "each_party": "each party"}
SCOPE = {"domestic": "in-country/domestic", "eu_eea": "EU/EEA", "uk": "UK", "us": "US"}
METRIC = {"deal_value": "deal value", "revenue_or_assets": "revenue or assets", "market_share": "market share"}


def _literal(rows: DataFrame) -> Column:
    """The rows as one constant array of structs, at most MOST_CONDITIONS of them."""
    found = rows.select(F.to_json(F.struct("*")).alias("j")).limit(MOST_CONDITIONS + 1).collect()
    if len(found) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions or rules")
    return F.from_json(F.lit("[" + ",".join(r.j for r in found) + "]"), ArrayType(rows.schema))


def _actual(c: Column) -> Column:
    """What the deal of a row has for a condition c (a struct)."""
    counted = nth_country(c["metric"], c["party"], c["q_count"], c["q_set"], c["currency"])
    return F.when(c["q_count"].isNotNull(), counted).otherwise(value_of(c["scope"], c["metric"], c["party"], c["currency"]))


def _compared(c: Column, actual: Column) -> Column:
    """Whether an actual value meets a condition; null without data, false for an unknown operator."""
    op = c["op"]
    met = F.when(op == ">", actual > c["value"]).when(op == ">=", actual >= c["value"]).when(op == "<", actual < c["value"]).when(op == "<=", actual <= c["value"])
    return F.when(actual.isNotNull(), F.coalesce(met, F.lit(False)))


def conditions_met(deals: DataFrame, conditions: DataFrame) -> DataFrame:
    """deal_id, rule_id, test_id, condition_id, actual, met (null: no data), gap, missing of every deal and condition.

    The conditions are a constant of the plan, checked to be small, and each deal's row unfolds them.
    """
    d = deals.withColumn("c", F.explode(_literal(conditions)))
    if "rule_id" in deals.columns:
        d = d.where(F.col("rule_id") == F.col("c.rule_id"))
    d = d.withColumn("actual", _actual(F.col("c")))
    label = lambda field, names: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(f"c.{field}")), F.col(f"c.{field}"))
    missing = F.concat_ws(" ", label("party", PARTY), label("scope", SCOPE), label("metric", METRIC))
    return d.select(
        "deal_id", "c.rule_id", "c.test_id", "c.condition_id", "c.pending", "c.value", "actual",
        _compared(F.col("c"), F.col("actual")).alias("met"),
        (F.col("c.value") - F.col("actual")).alias("gap"),
        F.when(F.col("actual").isNull(), missing).alias("missing"),
    )


def tests_fired(met: DataFrame) -> DataFrame:
    """deal_id, rule_id, test_id, fired: any failed condition makes a test false, else any without data null, else it is true.

    close: whether a condition that decides (all of a fired test, the failed ones of another) is within a tenth of its threshold.
    """
    near = (F.abs(F.col("actual") - F.col("value")) / F.col("value") < 0.1) & (F.col("value") > 0)
    g = met.groupBy("deal_id", "rule_id", "test_id").agg(
        F.bool_or("pending").alias("pending"),
        F.coalesce(F.bool_or(~F.col("met")), F.lit(False)).alias("failed"),
        F.bool_or(F.col("met").isNull()).alias("lacks"),
        F.coalesce(F.bool_or(near), F.lit(False)).alias("near"),
        F.coalesce(F.bool_or(near & ~F.col("met")), F.lit(False)).alias("near_failed"),
    )
    fired = F.when(F.col("pending"), F.lit(None)).when(F.col("failed"), False).when(F.col("lacks"), F.lit(None)).otherwise(True)
    g = g.withColumn("fired", fired.cast("boolean"))
    close = F.when(F.col("pending"), False).when(F.col("fired"), F.col("near")).otherwise(F.col("near_failed"))
    return g.select("deal_id", "rule_id", "test_id", "pending", "fired", close.alias("close"))


def statuses(tests: DataFrame) -> DataFrame:
    """deal_id, rule_id, status, triggered_by, confidence.

    Over the tests in force: none: not_triggered; all without data: data_insufficient; any fired: triggered; any without
    data: unclear; else not_triggered. Confidence: medium if data lack, else low if a deciding condition is close, else high.
    """
    on = ~F.col("pending")
    g = tests.groupBy("deal_id", "rule_id").agg(
        F.count_if(on).alias("n"),
        F.count_if(on & F.col("fired").isNull()).alias("nulls"),
        F.count_if(on & F.col("fired")).alias("hits"),
        F.coalesce(F.bool_or(on & F.col("close")), F.lit(False)).alias("close"),
        F.array_join(F.sort_array(F.collect_list(F.when(on & F.col("fired"), F.col("test_id")))), ",").alias("triggered_by"),
    )
    status = (
        F.when(F.col("n") == 0, "not_triggered")
        .when(F.col("nulls") == F.col("n"), "data_insufficient")
        .when(F.col("hits") > 0, "triggered")
        .when(F.col("nulls") > 0, "unclear")
        .otherwise("not_triggered")
    )
    confidence = F.when(F.col("nulls") > 0, "medium").when(F.col("close"), "low").otherwise("high")
    return g.select("deal_id", "rule_id", status.alias("status"), "triggered_by", confidence.alias("confidence"))


#: Notes on deals out of scope; %s are the deal type and the types covered, the share and the shares that count.
NOTES = {
    "type": "Transaction type '%s' is not a notifiable trigger event in this jurisdiction (covered: %s).",
    "minority": "This jurisdiction does not apply merger control to minority stakes that do not confer decisive influence or control. A purely passive minority acquisition is not a notifiable concentration.",
    "control": "No control or decisive influence acquired; transaction does not constitute a notifiable concentration under this jurisdiction's control standard.",
    "influence": "No material influence acquired; transaction does not meet this jurisdiction's control standard for notifiable concentrations.",
    "share": "Acquisition of %.1f%% does not meet the minority notification thresholds for this jurisdiction (%s). Filing not required solely on ownership percentage.",
    "other": "Minority stake does not meet the notification thresholds for this jurisdiction.",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _outside(r: Column) -> Column:
    """Struct (confidence, note) where a deal is out of the scope of rule r; else null."""
    kind, control, m = F.col("deal_type"), F.col("control"), r["minority"]
    rel, pct = F.col("relation"), F.col("pct_shares")
    out = lambda note, confidence="high": F.struct(F.lit(confidence).alias("confidence"), note.alias("note"))
    said = lambda name: out(F.lit(NOTES[name]))
    type_out = kind.isNotNull() & (F.size(r["triggers"]) > 0) & ~F.array_contains(r["triggers"], kind)
    minority = F.coalesce(kind == "minority_stake", F.lit(False)) | F.coalesce(control == "no_control", F.lit(False))
    none = F.coalesce(control == "no_control", F.lit(False))
    covers = lambda x: F.coalesce((x["relation"] == "any") | rel.isNull() | (x["relation"] == rel) | ((x["relation"] == "non_horizontal") & rel.isin("vertical", "conglomerate")), F.lit(False))
    over = lambda x: x["pct"].isNull() | pct.isNull() | ((x["op"] == ">=") & (pct >= x["pct"])) | ((x["op"] == ">") & (pct > x["pct"]))
    relevant = F.filter(m["rules"], covers)
    shares = F.array_join(F.transform(F.filter(relevant, lambda x: x["pct"].isNotNull()), lambda x: F.concat(x["relation"], F.lit(" "), x["op"], x["pct"].cast("string"), F.lit("%"))), ", ")
    by_share = F.when(pct.isNotNull() & (F.size(relevant) > 0), out(F.format_string(NOTES["share"], pct, shares))).otherwise(said("other"))
    stake = (
        F.when(~m["applies"], said("minority"))
        .when((m["standard"] == "control_based") & none, said("control"))
        .when((m["standard"] == "material_influence") & none, out(F.lit(NOTES["influence"]), "medium"))
        .when((m["standard"] == "percentage_based") & (F.size(m["rules"]) > 0) & ~F.exists(relevant, over), by_share)
    )
    covered = F.format_string(NOTES["type"], kind, F.array_join(r["triggers"], ", "))
    return F.when(F.coalesce(type_out, F.lit(False)), out(covered)).when(minority & m.isNotNull(), stake)


def prefiltered(deals: DataFrame, rules: DataFrame) -> DataFrame:
    """deal_id, rule_id, confidence, note of the pairs out of a rule's scope: not a trigger event, or a minority stake below its standard.

    rules: rule_id, triggers array, minority struct<applies, standard, rules array<struct<relation, op, pct>>> (null: no such block).
    """
    d = deals.drop("rule_id").withColumn("r", F.explode(_literal(rules))).withColumn("o", _outside(F.col("r")))
    return d.where("o is not null").select("deal_id", "r.rule_id", "o.confidence", "o.note")


def _tested(t: Column) -> Column:
    """Struct (test_id, pending, fired, close) of a test for the deal of a row."""
    each = F.transform(t["conditions"], lambda c: _let(_actual(c), lambda a: F.struct(a.alias("actual"), c["value"].alias("value"), _compared(c, a).alias("met"))))

    def of(cs: Column) -> Column:
        near = lambda x: F.coalesce((F.abs(x["actual"] - x["value"]) / x["value"] < 0.1) & (x["value"] > 0), F.lit(False))
        no = lambda x: F.coalesce(~x["met"], F.lit(False))
        fired = F.when(t["pending"], F.lit(None)).when(F.exists(cs, no), False).when(F.exists(cs, lambda x: x["met"].isNull()), F.lit(None)).otherwise(True).cast("boolean")
        return _let(fired, lambda f: F.struct(
            t["test_id"].alias("test_id"), t["pending"].alias("pending"), f.alias("fired"),
            F.when(t["pending"], False).when(f, F.exists(cs, near)).otherwise(F.exists(cs, lambda x: near(x) & no(x))).alias("close"),
        ))

    return _let(each, of)


def _settled(ts: Column) -> Column:
    """Struct (status, triggered_by, confidence) of a rule by its tests."""
    on = F.filter(ts, lambda t: ~t["pending"])

    def of(o: Column) -> Column:
        lacks, hit = lambda t: t["fired"].isNull(), lambda t: F.coalesce(t["fired"], F.lit(False))
        hits = F.array_sort(F.transform(F.filter(o, hit), lambda t: t["test_id"]))
        status = (
            F.when(F.size(o) == 0, "not_triggered")
            .when(F.forall(o, lacks), "data_insufficient")
            .when(F.exists(o, hit), "triggered")
            .when(F.exists(o, lacks), "unclear")
            .otherwise("not_triggered")
        )
        confidence = F.when(F.exists(o, lacks), "medium").when(F.exists(o, lambda t: t["close"]), "low").otherwise("high")
        return F.struct(status.alias("status"), F.array_join(hits, ",").alias("triggered_by"), confidence.alias("confidence"))

    return _let(on, of)


def _compiled(conditions: DataFrame, rules: DataFrame | None = None) -> Column:
    """Rules with their tests and conditions as one constant; rules none: those that have conditions."""
    if conditions.limit(MOST_CONDITIONS + 1).count() > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    of_test = [c for c in conditions.columns if c not in ("rule_id", "test_id", "pending")]
    t = conditions.groupBy("rule_id", "test_id").agg(F.bool_or("pending").alias("pending"), F.collect_list(F.struct(*of_test)).alias("conditions"))
    t = t.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("test_id", "pending", "conditions"))).alias("tests"))
    return _literal(t if rules is None else rules.join(t, "rule_id", "left"))


def _per_rule(deals: DataFrame, rules: Column, of: Callable[[Column], Column]) -> DataFrame:
    """A row for each deal and each of its rules (those of its rule_id, if it has one) with `of` the rule as x, worked out in the deal's row."""
    mine = F.filter(rules, lambda r: r["rule_id"] == F.col("rule_id")) if "rule_id" in deals.columns else rules
    return deals.select("deal_id", F.explode(F.transform(mine, of)).alias("x"))


def deal_tests(deals: DataFrame, conditions: DataFrame) -> DataFrame:
    """A15 of all rules in a deal's row: deal_id, rule_id, test_id, pending, fired, close; nothing is shuffled."""
    d = _per_rule(deals, _compiled(conditions), lambda r: F.struct(r["rule_id"].alias("rule_id"), F.transform(r["tests"], _tested).alias("tests")))
    return d.select("deal_id", "x.rule_id", F.explode("x.tests").alias("t")).select("deal_id", "rule_id", "t.*")


def deal_statuses(deals: DataFrame, conditions: DataFrame) -> DataFrame:
    """A16, A17 of all rules in a deal's row: deal_id, rule_id, status, triggered_by, confidence; nothing is shuffled."""
    d = _per_rule(deals, _compiled(conditions), lambda r: F.struct(r["rule_id"].alias("rule_id"), _settled(F.transform(r["tests"], _tested)).alias("s")))
    return d.select("deal_id", "x.rule_id", "x.s.*")


def _screen(r: Column, notes: Column) -> Column:
    """Struct (rule_id, status, triggered_by, confidence, notes) of a rule for the deal of a row: its scope first, then its tests."""
    none = F.struct(F.lit("not_triggered").alias("status"), F.lit("").alias("triggered_by"), F.lit("high").alias("confidence"))
    tested = F.when(r["tests"].isNull(), none).otherwise(_settled(F.transform(r["tests"], _tested)))
    row = lambda status, by, confidence, said: F.struct(r["rule_id"].alias("rule_id"), status.alias("status"), by.alias("triggered_by"), confidence.alias("confidence"), said.alias("notes"))
    inside = _let(tested, lambda x: row(x["status"], x["triggered_by"], x["confidence"], notes))
    return _let(_outside(r), lambda o: F.when(o.isNotNull(), row(F.lit("not_triggered"), F.lit(""), o["confidence"], F.array(o["note"]))).otherwise(inside))


def screened(deals: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """The whole screening: deal_id, rule_id, status, triggered_by, confidence, notes.

    Pairs out of scope have the status of their scope and a note on it, whatever their tests say; the rest go by their
    tests and have the rule's notes (a column of rules, array<string>, where there is one). A rule without tests is not triggered. The
    rules are one constant of the plan, and a deal meets all of them in its own row: no join, no shuffle.
    """
    nothing = F.array().cast("array<string>")
    said = (lambda r: F.coalesce(r["notes"], nothing)) if "notes" in rules.columns else lambda r: nothing  # noqa: ARG005
    return _per_rule(deals, _compiled(conditions, rules), lambda r: _screen(r, said(r))).select("deal_id", "x.*")


def ranked(results: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Results of the chosen rules (none chosen: all), triggered first.

    They are written first: a sort samples its input to part it, and would work all of it out twice.
    """
    place = F.coalesce(F.array_position(F.lit(STATUS_ORDER), F.col("status")), F.lit(0))
    r = kept(results.where(F.col("rule_id").isin(ids)) if ids else results, "results")
    return r.withColumn("place", F.when(place == 0, len(STATUS_ORDER)).otherwise(place).cast("int") - 1).orderBy("deal_id", "place", "rule_id")


def summary(results: DataFrame) -> DataFrame:
    """Per deal, how many filings, how many unclear."""
    return results.groupBy("deal_id").agg(F.count_if(F.col("status") == "triggered").alias("filings"), F.count_if(F.col("status").isin("unclear", "data_insufficient")).alias("unclear"))


def filing_counts(deals: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """A19 of the whole screening, counted in the deal's row: deal_id, filings, unclear."""
    nothing = F.array().cast("array<string>")
    d = deals.select("deal_id", F.transform(_compiled(conditions, rules), lambda r: _screen(r, nothing)["status"]).alias("s"))
    many = lambda *names: F.size(F.filter("s", lambda x: x.isin(*names))).cast("long")
    return d.select("deal_id", many("triggered").alias("filings"), many("unclear", "data_insufficient").alias("unclear"))


def mismatches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """deal_id, rule_id, expected, status where a gold deal's status differs."""
    return expected.join(results, ["deal_id", "rule_id"], "left").where(~F.col("status").eqNullSafe(F.col("expected"))).select("deal_id", "rule_id", "expected", "status")


def rule_currency(conditions: DataFrame, default: str = "EUR") -> DataFrame:
    """Each rule's currency: that of its first condition that has one, else the default."""
    return conditions.groupBy("rule").agg(F.coalesce(F.min_by("currency", F.when(F.col("currency").isNotNull(), F.col("seq"))), F.lit(default)).alias("currency"))
