"""Hidden semantics of the reports (distinct counting, raw-group DISTINCT,
latest check-in, rank ties) on hand-made rows."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.compare import digest
from devicelens.operators.rank import bucketed_rank, first_by_rank, rank_buckets, with_rank
from devicelens.plans import depot as D
from devicelens.plans import sales as S
from tests.conftest import tables

EVENTS = T.StructType([
    T.StructField("EventId", T.LongType()), T.StructField("BarCodeNumber", T.StringType()),
    T.StructField("FK_DeviceId", T.LongType()), T.StructField("EventCode", T.IntegerType()),
    T.StructField("SrcID", T.StringType()), T.StructField("DestID", T.StringType()),
    T.StructField("TimeStamp", T.TimestampNTZType()), T.StructField("FK_UserId", T.LongType())])
CLIENTS = "ID string, PK_ClientId long, FK_ParentCompanyId long, Name string"
ASSOCIATES = "UserId long, FK_ClientId long, Name string, ID string, ClientID string, Eid string"
DEVICES = ("DeviceUID long, BarCodeNumber string, DeviceCode string, Make string, Model string, "
           "Owner string, OwnerID string, DeviceType string, StatusDescription string, "
           "StatusCode string")


def ts(text):
    return dt.datetime.fromisoformat(text)


def _depot_tables(spark, events):
    clients = spark.createDataFrame([("00373", 1, 108, "Depot A"), ("77777", 2, 5, "Customer")],
                                    CLIENTS)
    assoc = spark.createDataFrame([(1, 1, "Tech One", "A1", "00373", "E1"),
                                   (2, 1, "Tech Two", "A2", "00373", "E2")], ASSOCIATES)
    devices = spark.createDataFrame([(10, "B1", "556", "Breas", "M", "O", "77777", "Ventilator",
                                      "In Service", "IS")], DEVICES)
    return tables(spark, events=spark.createDataFrame(events, EVENTS), clients=clients,
                  associates=assoc, devices=devices)


def test_activity_counts_distinct_rows(spark):
    same_tech = [(1, "B1", 10, 3, "77777", "00373", ts("2024-11-05 10:00"), 1),
                 (2, "B1", 10, 3, "77777", "00373", ts("2024-11-20 10:00"), 1)]
    two_techs = [(1, "B1", 10, 3, "77777", "00373", ts("2024-11-05 10:00"), 1),
                 (2, "B1", 10, 3, "77777", "00373", ts("2024-11-20 10:00"), 2)]

    def count(events, dedupe=True):
        t = _depot_tables(spark, events)
        rows = D.depot_activity(t, start="2024-11-01", end="2024-12-01", dedupe=dedupe).collect()
        return sum(r.eventCount for r in rows)

    assert count(same_tech) == 1
    assert count(two_techs) == 2
    assert count(same_tech, dedupe=False) == 2
    assert count(two_techs, dedupe=False) == 2


def test_turnaround_uses_overall_latest_check_in(spark):
    events = [(1, "B1", 10, 1, "77777", "00373", ts("2024-11-01 08:00"), 1),
              (2, "B1", 10, 1, "77777", "00373", ts("2024-11-10 08:00"), 1)]
    tickets = spark.createDataFrame(
        [(100, 10, 1, "B1", "Closed", "00373", "RT100", None, "Tech 1", "Repair", "Tech 1",
          ts("2024-11-02 08:00"), ts("2024-11-05 09:00"), ts("2024-11-05 09:00")),
         (101, 10, 1, "B1", "Closed", "00373", "RT101", None, "Tech 1", "Repair", "Tech 1",
          ts("2024-11-11 08:00"), ts("2024-11-12 09:00"), ts("2024-11-12 09:00"))],
        "PK_RepairTicketId long, FK_DeviceId long, FK_RepairPerformedById long, "
        "BarCodeNumber string, Status string, PerformedAt string, RepairTicketNo string, "
        "VendorRMANumber string, RepairedBy string, RepairType string, PMPerformedBy string, "
        "DateOpened timestamp_ntz, DateRepairCompleted timestamp_ntz, "
        "DateLastModified timestamp_ntz")
    rma = spark.createDataFrame([], "PK_RMATrackerId long, FK_RepairTicketId long")
    t = _depot_tables(spark, events).override(repair_tickets=tickets, rma_tracker=rma)
    rows = D.repair_turnaround(t, as_of="2025-01-01").collect()
    assert [(r.PK_RepairTicketId, r.repairDays) for r in rows] == [(101, 2)]


def test_first_rank_keeps_ties_and_null_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", 5)],
                               "k string, v int")
    got = sorted((r.k, r.v) for r in first_by_rank(df, "k", "v", "r").collect())
    assert got == [("a", 1), ("a", 1), ("b", None)]
    ranks = sorted((r.k, r.v, r.r) for r in with_rank(df, "k", "v", "r").collect()
                   if r.v is not None)
    assert ranks == [("a", 1, 1), ("a", 1, 1), ("a", 2, 3), ("b", 5, 2)]


def test_hot_barcode_day_is_split_and_ranked_alike(spark):
    """A third of all rows on one day of one barcode: many small pieces, the window's ranks."""
    at = F.expr("CASE WHEN id % 3 = 0 THEN timestamp_ntz'2024-05-01 08:00:00' + make_dt_interval(0, 0, 0, (id * 7919) % 5000)"
                " WHEN id % 50 = 1 THEN NULL ELSE timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(id % 40, id % 5) END")
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 11) END")
    df = spark.range(9000).select("id", key.alias("k"), at.alias("t"), F.lit("x").alias("n"))
    got = {r.id: r.r for r in bucketed_rank(df, "k", "t", "r", most=200, splits=32).collect()}
    assert got == {r.id: r.r for r in with_rank(df, "k", "t", "r").collect()}
    sizes = [r["count"] for r in rank_buckets(df, ["k"], "t", most=200, splits=32).groupBy("k", "__bucket", "__range").count().select("count").collect()]
    assert sum(sizes) == 9000 and max(sizes) < 200
    one = df.withColumn("t", F.lit("2024-05-01 08:00:00").cast("timestamp_ntz"))  # ties can't be parted: all rank first
    assert {r.r for r in bucketed_rank(one, "k", "t", "r", most=200, splits=32).collect()} == {1}


def test_bucketed_rank_equals_window_rank(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = "HOT" if i % 3 == 0 else (None if i % 97 == 0 else f"k{rnd.randrange(40)}")
        t = None if i % 89 == 0 else base + dt.timedelta(hours=rnd.randrange(0, 24 * 60))
        rows.append((i, key, t))
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz")
    a = {r.id: r.r for r in with_rank(df, "k", "t", "r").collect()}
    b = {r.id: r.r for r in bucketed_rank(df, "k", "t", "r").collect()}
    assert a == b


def test_raw_group_distinct_merges_null_and_other(driver_t, spark):
    """A device code listed twice in the device index, once with a NULL group
    and once with 'Other', doubles its lines; grouping by the raw value keeps
    two groups that print alike, and the DISTINCT folds them back into one."""
    di = driver_t["device_index"]
    single = di.select("DEVICE_CODE", "TYPE", F.lit("Other").alias("DEVICE_GROUP_LVL_1"),
                       F.lit("X").alias("DEVICE_GROUP_LVL_2"))
    doubled = single.unionByName(single.withColumn("DEVICE_GROUP_LVL_1", F.lit(None).cast("string")))
    kw = dict(min_fiscal_month="199500", with_uom_cost=False)
    base = S.transactions(driver_t.override(device_index=single), **kw)
    raw = S.transactions(driver_t.override(device_index=doubled), **kw)
    merged = S.transactions(driver_t.override(device_index=doubled), merge_other=True, **kw)
    assert base.count() == raw.count() == merged.count()
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    assert same(raw) == same(base)
    total = lambda df: float(df.agg(F.sum("NET_SLS")).first()[0] or 0)
    assert abs(total(merged) - 2 * total(base)) < 1e-6 * abs(total(base))


def test_report_pack_reads_checkpointed_lines(driver_t, spark):
    pack = S.sales_reports(driver_t, min_fiscal_month="199500")
    direct = S.gl_measures(driver_t, min_fiscal_month="199500")
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    assert same(pack["gl_measures"]) == same(direct)
    assert spark.sparkContext.getCheckpointDir()


def test_report_sets_equal_the_single_reports(driver_t):
    kw = dict(min_fiscal_month="199500")
    lines = S.sales_lines(driver_t, **kw)
    pack = S.sales_reports(driver_t, materialize=False, **kw)
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    for name in S.REPORT_SETS:
        single = getattr(S, name)(driver_t, lines=lines, **kw)
        assert pack[name].dtypes == single.dtypes
        assert same(pack[name]) == same(single), name


def _many_lines(driver_t):
    """Facts with repeated keys, NULL flags, customers and amounts; repeated dimension keys."""
    f = driver_t["fact_sales"]
    odd = F.col("SLS_ID") % 5
    f = (f.withColumn("BIOMED_FLG", F.when(odd == 0, F.lit(None)).otherwise(F.col("BIOMED_FLG")))
         .withColumn("EXT_NET_SLS_AMT", F.when(odd == 1, F.lit(None)).otherwise(F.col("EXT_NET_SLS_AMT")))
         .withColumn("EXT_COGS_ACQ_AMT", F.when(odd == 2, F.lit(None)).otherwise(F.col("EXT_COGS_ACQ_AMT"))))
    repeated = f.unionByName(f.where(odd < 3)).unionByName(f.withColumn("EXT_SELL_GP_FIN_AMT", -F.col("EXT_SELL_GP_FIN_AMT")))
    double = lambda name, where: driver_t[name].unionByName(driver_t[name].where(where))
    return driver_t.override(
        fact_sales=repeated, gl_accounts=double("gl_accounts", "DIM_GL_ACCT_ID IN (1, 3)"),
        items=double("items", "DIM_ITEM_E1_CURR_ID % 7 = 0"), biomed_sales=double("biomed_sales", "DIM_BIOMED_SLS_ID % 3 = 0"),
        account_managers=double("account_managers", "DIM_ACCT_MGR_CURR_ID % 2 = 0"),
        # The same customer with and without a biomed account.
        customers_blend=driver_t["customers_blend"].unionByName(
            driver_t["customers_blend"].where("DIM_CUST_CURR_ID % 4 = 0").withColumn("BIOMED_ACCT_FLG", F.lit(None).cast("string"))))


def test_sums_before_the_joins_equal_sums_after_them(driver_t, monkeypatch):
    t, kw = _many_lines(driver_t), dict(min_fiscal_month="199500")
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    assert S.sales_groups(t, **kw).count() < 0.6 * S.sales_lines(t, **kw).count()
    got = [same(S.transactions(t, **kw)), same(S.gl_measures(t, **kw)), same(S.uom_cost(t, **kw))]
    monkeypatch.setattr(S, "sales_groups", S.sales_lines)
    monkeypatch.setattr(S, "biomed_facts", lambda t, facts: facts)
    assert [same(S.transactions(t, **kw)), same(S.gl_measures(t, **kw)), same(S.uom_cost(t, **kw))] == got


def test_flag_branches_keep_every_reported_line(driver_t):
    t = _many_lines(driver_t)
    kept = S.biomed_facts(t, t["fact_sales"])
    flagged = [r[0] for r in t["customers_blend"].where("BIOMED_ACCT_FLG = 'Y'").select("DIM_CUST_CURR_ID").distinct().collect()]
    want = t["fact_sales"].where((F.col("BIOMED_FLG") == "Y") | F.col("DIM_CUST_CURR_ID").isin(flagged))
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    assert 0 < kept.where("BIOMED_FLG IS NULL").count() < t["fact_sales"].where("BIOMED_FLG IS NULL").count()


def test_weighted_unit_cost_is_exact(spark):
    df = spark.sql("SELECT CAST(d AS DECIMAL(18,4)) AS PRMRY_TO_SELL_DIVISOR, CAST(c AS DECIMAL(18,4)) AS STNDRD_COST_AMT, "
                   "CAST(n AS BIGINT) AS LINES FROM VALUES (3, 1.0, 300000), (7, -2.5, 70001), (0, 9.9, 5), (3, 10000000.0001, 900000), "
                   "(NULL, 1.0, 2), (7, NULL, 3) AS v(d, c, n)")
    lines = df.withColumn("LINES", F.explode(F.sequence(F.lit(1), F.col("LINES").cast("int"))))
    assert df.agg(S.uom_cost_sum(F.col("LINES")).alias("x")).first().x == lines.agg(S.uom_cost_sum().alias("x")).first().x


def test_sales_types_are_total(driver_t):
    lines = S.sales_lines(driver_t, min_fiscal_month="199500")
    nulls = lines.where(F.col("SALES_TYPE").isNull() | F.col("CONSOL_SALES_TYPE").isNull())
    assert lines.count() > 0 and nulls.count() == 0


def _reference_transactions(t, min_fiscal_month):
    """The report's aggregation written directly: GROUP BY raw groups, label,
    DISTINCT (no specialists, no UOM cost)."""
    lines = S.sales_lines(t, min_fiscal_month=min_fiscal_month)
    keys = list(S.KEYS)
    agg = lines.groupBy(*keys, "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2").agg(*S.measures(False))
    names = [c for c in agg.columns if c not in (*keys, "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2")]
    return agg.select(*keys[:13], S.R.group_name_trim(F.col("MSTR_GRP_NAME"))
                      .alias("MSTR_GRP_NAME_TRIM"), *keys[13:], *names).distinct()


def test_dealt_aggregation_equals_group_by_raw_then_distinct(driver_t):
    """Device codes listed as NULL twice and Other once: the NULL variant has
    twice the measures, so both rows survive the DISTINCT."""
    di = driver_t["device_index"]
    other = di.select("DEVICE_CODE", "TYPE", F.lit("Other").alias("DEVICE_GROUP_LVL_1"),
                      F.col("DEVICE_GROUP_LVL_2"))
    null = other.withColumn("DEVICE_GROUP_LVL_1", F.lit(None).cast("string"))
    t = driver_t.override(device_index=other.unionByName(null).unionByName(null))
    got = S.transactions(t, min_fiscal_month="199500", with_uom_cost=False)
    want = _reference_transactions(t, "199500")
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    assert same(got) == same(want)
    assert got.count() > S.transactions(driver_t, min_fiscal_month="199500",
                                         with_uom_cost=False).count()


def test_event_history_for_serials_equals_filtered_full_history(driver_t):
    from devicelens.plans import devices as V
    full = V.event_history(driver_t, serials=None)
    serials = [r.SerialNumber for r in full.select("SerialNumber").distinct().limit(3).collect()]
    one = V.event_history(driver_t, serials=serials)
    same = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])
    assert one.count() > 0
    assert same(one) == same(full.where(F.col("SerialNumber").isin(serials)))


def test_repeated_price_list_key_multiplies_lines(driver_t):
    """H3: a price-list item listed twice for the OT org joins every line of
    that device twice, so its sums double; other devices are unchanged."""
    pl = driver_t["price_list"].distinct()
    driver_t = driver_t.override(price_list=pl)
    t2 = driver_t.override(price_list=pl.unionByName(pl))
    kw = dict(min_fiscal_month="199500", with_uom_cost=False)
    base, dup = S.transactions(driver_t, **kw), S.transactions(t2, **kw)
    ot = [r.PLY553PLITM for r in pl.where(F.col("PLTORG") == "OT").collect()]
    total = lambda df: float(df.agg(F.sum("NET_SLS")).first()[0] or 0)
    hit = total(base.where(F.col("DEVICE_CD").isin(ot)))
    assert hit > 0
    assert abs(total(dup) - (total(base) + hit)) < 1e-6 * total(base)


def test_fixture_exercises_the_report(driver_t):
    """Groups of several lines, DISTINCT merges, two specialists on a bill-to,
    lines without customer and of the flagged account."""
    kw = dict(min_fiscal_month="199500")
    lines = S.sales_lines(driver_t, **kw)
    keys = list(S.KEYS)
    groups = lines.groupBy(*keys, "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2").count()
    assert groups.count() < lines.count()
    assert S.transactions(driver_t, with_uom_cost=False, **kw).count() < groups.count()
    assert S.biomed_rep(driver_t, as_of="2025-03-03").groupBy("BILL_TO_CUST_NUM").count().where("count > 1").count() > 0
    assert lines.where("DIM_CUST_CURR_ID IS NULL").count() > 0
    assert lines.where(F.col("BILL_TO_CUST_NUM").isin(list(S.R.PPPM_BILL_TO))).count() > 0


def test_repeated_period_id_multiplies_lines_twice(driver_t):
    """The source joins the period twice, so an id listed twice gives four rows a line."""
    once = S.sales_lines(driver_t, min_fiscal_month="199500")
    day = once.join(driver_t["fact_sales"].select("INV_NUM", "DIM_GL_DT_ID"), "INV_NUM").first()["DIM_GL_DT_ID"]
    period = driver_t["period"]
    twice = driver_t.override(period=period.unionByName(period.where(F.col("DIM_PERIOD_ID") == day).withColumn("DT", F.lit(None).cast("date"))))
    hit = driver_t["fact_sales"].where(F.col("DIM_GL_DT_ID") == day).select("INV_NUM")
    before = once.join(hit.distinct(), "INV_NUM", "left_semi").count()
    after = S.sales_lines(twice, min_fiscal_month="199500").join(hit.distinct(), "INV_NUM", "left_semi").count()
    other = once.count() - before
    assert S.sales_lines(twice, min_fiscal_month="199500").count() == other + after and after > before


def test_unreadable_rent_starts_are_counted_and_strict_mode_raises(driver_t):
    import pytest

    assert sum(r.ROW_COUNT for r in S.unreadable_rent_starts(driver_t).collect()) > 0
    with pytest.raises(ValueError, match="99/99/999"):
        S.check_rent_starts(driver_t)
    S.check_rent_starts(driver_t.override(biomed_sales=driver_t["biomed_sales"].withColumn("BILL_START_END", F.lit("01/02/2024"))))


def test_make_matches_in_any_case(driver_t):
    from devicelens.plans import devices as V
    makes = {r.Make for r in V.ranked_events(driver_t).select("Make").distinct().collect()}
    assert {"BREAS", "Breas"} <= makes


def test_published_table_is_read_by_another_session(spark, driver_t):
    report = S.group_name_trim(driver_t)
    S.publish_table(report, "TRIMMED_GROUP_TABLE")
    other = spark.newSession()
    assert other.table("TRIMMED_GROUP_TABLE").count() == report.count()
    spark.sql("DROP TABLE TRIMMED_GROUP_TABLE")


def test_unit_cost_is_rounded_after_the_sum(spark):
    df = spark.sql("SELECT CAST(3 AS DECIMAL(18,4)) AS PRMRY_TO_SELL_DIVISOR, CAST(0.0001 AS DECIMAL(18,4)) AS STNDRD_COST_AMT "
                   "FROM range(30000)")
    assert float(df.agg(S.uom_cost_sum().alias("x")).first().x) == 1.0


def test_repeat_rows_equals_the_left_join(spark):
    from devicelens.operators.joins import repeat_rows
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, v string")
    dim = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "id int")
    want = sorted(r.v for r in left.join(dim, left.k == dim.id, "left").collect())
    assert sorted(r.v for r in repeat_rows(left, "k", dim, "id").collect()) == want
