from __future__ import annotations

import random

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.functions import calendars
from tallywright.functions.tables import constant_table
from tallywright.operators import criteria as J, numbering as Q, results as R
from tallywright.operators.event_rate import over_limit_events
from tallywright.plans.views import PARAMETER_SCHEMA

ROW = ("engagement_id string, load_order bigint, effective_date date, created_date date, created_seconds int, entry_id string, "
       "document_number string, net_amount decimal(18,2), description string, user_name string, account string")
WEIGHTS = {"w_holiday": 4, "w_backdated": 4, "w_unauthorised_user": 4, "w_related_party_text": 4, "w_blank_description": 4}


def journal(spark, *changes):
    base = dict(engagement_id="E", effective_date=date(2026, 1, 7), created_date=date(2026, 1, 8), created_seconds=32400, entry_id="1",
                document_number="1", net_amount=Decimal("11.11"), description="Operazione ordinaria", user_name="AUTORIZZATO", account="100100")
    names = [f.split(" ")[0] for f in ROW.split(", ")]
    rows = [tuple({**base, "load_order": i, **change}[n] for n in names) for i, change in enumerate(changes)]
    return constant_table(spark, ROW, rows)


def params(spark, **changes):
    base = dict(engagement_id="E", performance_materiality=Decimal(700), net_profit=Decimal(1000), mean_entry=Decimal(10), round_threshold=Decimal(10),
                office_start=30600, office_end=61200, backdating_days=60, country=None, investigate_threshold=4, rare_account_threshold=None,
                weekend_days=[5, 6], manual_holidays=[date(2026, 1, 6)], authorised_users=["AUTORIZZATO"], system_users=None,
                keywords=["Società Collegata"], intragroup_accounts=None)
    base.update(changes)
    table = constant_table(spark, PARAMETER_SCHEMA, [tuple(base[f.strip().split(" ")[0]] for f in PARAMETER_SCHEMA.replace("decimal(18,2)", "d").split(","))])
    weights = {w: F.lit(WEIGHTS.get(w, 1)) for w in J.WEIGHTS.values() if w not in ("w_rare_account", "w_intragroup_account")}
    return table.withColumns({**weights, "w_rare_account": F.lit(None).cast("int"), "w_intragroup_account": F.lit(None).cast("int")})


def flags(spark, name, rows, **changes):
    scored = J.score_journal(journal(spark, *rows), params(spark, **changes))
    return [r[0] for r in scored.orderBy("load_order").select(name).collect()]


PAIRS = [
    ("profit_impact", dict(net_amount=Decimal("100.01")), dict(net_amount=Decimal("100.00"))),
    ("over_ten_times_mean", dict(net_amount=Decimal("-100.01")), dict(net_amount=Decimal("100.00"))),
    ("over_performance_materiality", dict(net_amount=Decimal("700.01")), dict(net_amount=Decimal("700.00"))),
    ("round_amount", dict(net_amount=Decimal("-120")), dict(net_amount=Decimal("121"))),
    ("weekend", dict(effective_date=date(2026, 1, 10)), {}),
    ("holiday", dict(effective_date=date(2026, 1, 6)), {}),
    ("out_of_hours", dict(created_seconds=17 * 3600 + 60), dict(created_seconds=17 * 3600)),
    ("backdated", dict(created_date=date(2026, 3, 8)), dict(created_date=date(2026, 3, 7))),
    ("unauthorised_user", dict(user_name="ESTERNO"), {}),
    ("related_party_text", dict(description="Pagamento SOCIETÀ COLLEGATA"), dict(description="Pagamento fornitore")),
    ("blank_description", dict(description="   "), dict(description="Presente")),
]


@pytest.mark.parametrize("name,yes,no", PAIRS, ids=[p[0] for p in PAIRS])
def test_boundary_pairs(spark, name, yes, no):
    assert flags(spark, name, [yes, no]) == [True, False]


MISSING = dict(profit_impact="net_profit", over_performance_materiality="performance_materiality", round_amount="round_threshold",
               weekend="weekend_days", holiday="manual_holidays", out_of_hours="office_end", backdated="backdating_days",
               unauthorised_user="authorised_users", related_party_text="keywords", intragroup_account="intragroup_accounts")


def test_missing_parameter_is_null_and_gives_no_points(spark):
    none = {p: None for p in MISSING.values()}
    scored = J.score_journal(journal(spark, dict(net_amount=Decimal(0))), params(spark, mean_entry=None, **none))
    row = scored.select(*MISSING, "over_ten_times_mean", "rare_account", "risk_score", "blank_description").first()
    assert row.blank_description is False and row.risk_score == 0
    assert all(row[name] is None for name in [*MISSING, "over_ten_times_mean", "rare_account"])


def test_empty_list_differs_from_missing_list(spark):
    assert flags(spark, "unauthorised_user", [{}], authorised_users=[]) == [True]
    assert flags(spark, "related_party_text", [{}], keywords=[]) == [False]
    assert flags(spark, "weekend", [dict(effective_date=date(2026, 1, 10))], weekend_days=[], country="IT") == [False]
    assert flags(spark, "unauthorised_user", [dict(user_name="BATCH")], system_users=["BATCH"]) == [None]


def test_weekend_and_holiday_add_the_larger_weight(spark):
    both = dict(effective_date=date(2026, 1, 6), net_amount=Decimal("11.11"))
    assert flags(spark, "risk_score", [both], weekend_days=[1]) == [4]


def test_country_and_manual_holidays_join(spark):
    days = [date(2026, 1, 6), date(2026, 1, 7), date(2026, 12, 25), date(2031, 1, 1)]
    rows = [dict(effective_date=d, created_date=None) for d in days]
    assert flags(spark, "holiday", rows, country="IT", manual_holidays=[date(2026, 1, 7)]) == [True, True, True, False]
    assert flags(spark, "holiday", rows, country="IT", manual_holidays=None) == [True, False, True, None]
    assert flags(spark, "holiday", rows[:1], country="IL", manual_holidays=None) == [None]
    with pytest.raises(Exception, match="not covered"):
        J.score_journal(journal(spark, rows[3]), params(spark, country="IT"), strict_calendar=True).collect()


def test_population_mean_ignores_zero_and_is_null_without_values(spark):
    rows = journal(spark, dict(net_amount=Decimal(10)), dict(net_amount=Decimal(-20)), dict(net_amount=Decimal(0)))
    assert J.population_mean(rows).first().population_mean == Decimal("15.0000")
    assert J.population_mean(journal(spark, dict(net_amount=Decimal(0)))).first().population_mean is None


def test_rare_account_is_strict(spark):
    rows = [dict(account="A"), dict(account="A"), dict(account="B"), dict(account=None)]
    assert flags(spark, "rare_account", rows, rare_account_threshold=2) == [False, False, True, None]
    assert flags(spark, "account_rows", rows) == [2, 2, 1, None]


def test_score_equals_points_of_reasons_and_ignores_partitioning(spark):
    from tallywright.plans.views import journal as view, parameters

    rows = view(spark, "/root/testdata/sf0.001")
    one = J.score_journal(rows, parameters(spark)).select("load_order", "risk_score", "reasons").orderBy("load_order").collect()
    many = J.score_journal(rows.repartition(13), parameters(spark)).select("load_order", "risk_score", "reasons").orderBy("load_order").collect()
    assert one == many


def test_list_parameters_from_rows(spark):
    base = constant_table(spark, "engagement_id string", [("E0",), ("E1",)])
    values = constant_table(spark, "engagement_id string, list_name string, value string",
                            [("E0", "authorised_users", "U1"), ("E0", "manual_holidays", "2026-01-06"), ("E0", "keywords", None)])
    present = constant_table(spark, "engagement_id string, list_name string",
                             [("E0", "authorised_users"), ("E0", "manual_holidays"), ("E0", "keywords"), ("E1", "system_users")])
    rows = {r.engagement_id: r for r in J.parameters_from_lists(base, values, present).collect()}
    assert rows["E0"].authorised_users == ["U1"] and rows["E0"].manual_holidays == [date(2026, 1, 6)] and rows["E0"].keywords == []
    assert rows["E0"].system_users is None and rows["E1"].system_users == [] and rows["E1"].keywords is None


def numbers(spark, *values):
    return constant_table(spark, "engagement_id string, document_number string", [("E", v) for v in values])


def test_numbering(spark):
    rows = numbers(spark, "1", "2", "2", "5", "A7", None, " 0008 ")
    assert sorted(r.expected_number for r in Q.sequence_missing(rows).collect()) == ["3", "4", "6", "7"]
    far = numbers(spark, "10", "999999", "1000001", "4220425800000010", "12345678901234567890123456789012345678")
    assert [r.expected_number for r in Q.sequence_missing(far, 3).collect()] == ["1000000"]
    wide = {(r.previous_number, r.next_number, r.missing_count) for r in Q.sequence_wide_gaps(far, 3).collect()}
    assert ("10", "999999", "999988") in wide and ("1000001", "4220425800000010", "4220425799000008") in wide and len(wide) == 3
    with pytest.raises(ValueError):
        Q.sequence_missing(rows, -1)
    long = numbers(spark, "1" * 39, "2", "4", "0" * 40 + "5")
    assert [r.expected_number for r in Q.sequence_missing(long).collect()] == ["3"]
    assert [(r.previous_number, r.next_number, r.missing_count) for r in Q.sequence_wide_gaps(long).collect()] == [("5", "1" * 39, "1" * 37 + "05")]


def test_numbers_of_any_length(spark):
    """Distinct numbers of 6 to 72 digits, with borders of ranges and of decimal arithmetic among them."""
    r = random.Random(3)
    bases = [10**5, 10**17, 10**18, 10**37, 10**38 - 50, 10**38, 10**39, 10**54 - 3, 10**60, 10**71 - 1]
    held = sorted({b + r.randint(0, 60) for b in bases for _ in range(12)} | {7 * b for b in bases})
    rows = numbers(spark, *[("00" if n % 3 == 0 else "") + str(n) for n in held], "x1", None)
    gaps = [(a, b, b - a - 1) for a, b in zip(held, held[1:]) if b - a > 1]
    assert sorted((int(x.previous), int(x.following), int(x.missing)) for x in Q.numbering_gaps(rows).collect()) == gaps
    assert sorted(int(x.expected_number) for x in Q.sequence_missing(rows, 50).collect()) == [k for a, b, m in gaps if m <= 50 for k in range(a + 1, b)]
    assert sorted((int(x.previous_number), int(x.next_number), int(x.missing_count)) for x in Q.sequence_wide_gaps(rows, 50).collect()) == [
        g for g in gaps if g[2] > 50]


def test_calendar(spark):
    assert [d.strftime("%m-%d") for d in calendars.holidays_of("ES", 2026)] == "01-01 01-06 04-03 05-01 08-15 10-12 12-08 12-25".split()
    assert calendars.holidays_of("IL", 2024) == [] and calendars.holidays_of("ES", 2027) == []
    assert [d.strftime("%m-%d") for d in calendars.holidays_of("DE", 2029)] == "01-01 03-30 04-02 05-01 05-10 05-21 10-03 12-25 12-26".split()
    assert calendars.holiday_calendar(spark, "IT", 2026, 2026).count() == 12
    for call in (lambda: calendars.holiday_calendar(spark, "XX"), lambda: calendars.holiday_calendar(spark, "IT", 2023, 2024),
                 lambda: calendars.holiday_calendar(spark, "IT", 2026, 2025)):
        with pytest.raises(ValueError):
            call()


def test_pages_cover_every_row_once(spark):
    rows = spark.range(2503).select(F.col("id").alias("load_order"), (F.col("id") % 7).cast("int").alias("risk_score"))
    seen = [r.load_order for page in range(1, 4) for r in R.page_results(rows, page, 1000).collect()]
    assert sorted(seen) == list(range(2503))
    assert R.page_totals(rows, 1000).first().asDict() == {"total": 2503, "pages": 3}


@pytest.mark.parametrize("width", [10, 400, 1_000_000])
def test_deep_pages_do_not_depend_on_ranges(spark, width):
    rows = spark.range(2503).select((F.col("id") * 7 % 2503).alias("load_order"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("int").alias("risk_score"))
    want = [r.load_order for r in rows.orderBy(F.col("risk_score").desc(), "load_order").collect()]
    for page in (1, 2, 17, 50, 51, 52):
        assert [r.load_order for r in R.page_results(rows, page, 50, width).collect()] == want[(page - 1) * 50 : page * 50]


def test_null_aware_sort(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert [r.k for r in R.null_aware_sort(rows, "k").collect()] == ["a", "b", None]
    assert [r.k for r in R.null_aware_sort(rows, "k", "desc").collect()] == [None, "b", "a"]


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_event_rate_against_brute_force(spark, slices):
    import random

    rng = random.Random(5)
    times = sorted({(k, rng.randrange(0, 400)) for k in "ab" for _ in range(120)})
    rows = spark.createDataFrame(times, "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    got = {(r.key, int(r.ts.timestamp())): r.earlier for r in over_limit_events(rows, 3, 60, slices).collect()}
    want = {(k, t): sum(1 for k2, u in times if k2 == k and t - 60 < u < t) for k, t in times}
    assert {k: v for (k, v) in zip(want, want.values())} == {k: got[k] for k in want} and len(got) == len(want)
