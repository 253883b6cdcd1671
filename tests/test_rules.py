"""Business-rule branches (order matters) and NULL behaviour."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from devicelens.functions import rules as R

DEPOT, OTHER_DEPOT, OUTSIDE = "00373", "18885", "99999"


def _one(spark, col, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_event_type_branches(spark):
    rows = [(903, DEPOT, OTHER_DEPOT), (903, DEPOT, OUTSIDE), (4, OUTSIDE, DEPOT), (3, OUTSIDE, OUTSIDE),
            (33, OUTSIDE, OUTSIDE), (924, DEPOT, DEPOT), (2, OUTSIDE, OUTSIDE), (1, DEPOT, DEPOT),
            (8, DEPOT, OUTSIDE)]
    col = R.event_type(F.col("c"), F.col("s"), F.col("d"))
    got = _one(spark, col, rows, "c int, s string, d string")
    assert got == [None, "Shipped", None, "PM", "PM", "Repair", "Cleaned", None, "Shipped"]
    no_reloc = R.event_type(F.col("c"), F.col("s"), F.col("d"), with_relocation=False)
    assert _one(spark, no_reloc, rows[:2], "c int, s string, d string") == [None, None]


def test_sale_rental_labels(spark):
    internal = "10415"
    rows = [(internal, 4, OUTSIDE, OUTSIDE),     # owner outside -> Sale
            (internal, 4, OUTSIDE, internal),    # owner inside -> Rental
            (internal, 4, OUTSIDE, None),        # owner unknown -> NULL
            (internal, 4, internal, OUTSIDE),    # destination inside -> NULL
            (internal, 8, internal, OUTSIDE),    # transfer between internal sites
            (OUTSIDE, 4, OUTSIDE, OUTSIDE)]      # not from an internal site
    col = R.sale_rental(F.col("s"), F.col("c"), F.col("d"), F.col("o"))
    got = _one(spark, col, rows, "s string, c int, d string, o string")
    assert got == ["Sale", "Rental", None, None, R.TRANSFER_LABEL, None]


@pytest.mark.parametrize("item,cust,line,sub,sales,consol", [
    ("1167556", "1", "B4", None, "New Equipment", "Service"),
    ("1167563", "1", "B4", None, "Freight", "Other"),
    ("1", "65296447", "B5", None, "Service", "Service"),
    ("1167552", "1", "B3", None, "OneTrack", "OneTrack"),
    ("1", "1", "B5", None, "Used Equipment", "Equipment"),
    ("1", "1", None, "Infusion Pumps - Used LVP", "Used Equipment", "Equipment"),
    ("1", "1", None, "Infusion Pumps - New LVP", "New Equipment", "Equipment"),
    ("1167556", "1", None, None, "Service", "Service"),
    ("1200820", "1", None, None, "Rental", "Rental"),
    (None, None, None, None, "Service", "Service"),
])
def test_sales_type_order(spark, item, cust, line, sub, sales, consol):
    df = spark.createDataFrame([(item, cust, line, sub)], "i string, c string, l string, s string")
    args = (F.col("i"), F.col("c"), F.col("l"), F.col("s"))
    got = df.select(R.sales_type(*args), R.consolidated_sales_type(*args)).first()
    assert tuple(got) == (sales, consol)


def test_division_and_trim(spark):
    codes = _one(spark, R.division(F.col("c")), [("06",), ("10",), ("45",), ("36",), ("6",), (None,)],
                 "c string")
    assert codes == ["HME", "PAC", "HIT", "SIMPLY MED", "other", "other"]
    names = _one(spark, R.group_name_trim(F.col("n")),
                 [("BIO - ACME",), ("BIO-ACME",), ("BIO ACME",), ("SYMBIO - X",)], "n string")
    assert names == ["ACME", "ACME", "ACME", "SYMX"]


def test_device_classes(spark):
    rows = [("Pump - Enteral",), ("Pump - Syringe",), ("DME-Ventilator",), ("Pump",), ("Cable",),
            (None,)]
    lvl1 = _one(spark, R.device_class(F.col("t")), rows, "t string")
    lvl2 = _one(spark, R.device_class_lvl2(F.col("t")), rows, "t string")
    assert lvl1 == ["Device", "Device", "Device", "Device", "Accessory", "Accessory"]
    assert lvl2 == ["Pump - Enteral", "Pump - Infusion", "Ventilator", "Other", "Accessory",
                    "Accessory"]


def test_null_in_a_difference_is_skipped(spark):
    df = spark.createDataFrame([(Decimal("10"), Decimal("1")), (Decimal("5"), None)],
                               "net decimal(18,4), cost decimal(18,4)")
    row = df.agg(F.sum(F.col("net") - F.col("cost")), F.sum("net") - F.sum("cost")).first()
    assert (row[0], row[1]) == (Decimal("9"), Decimal("14"))


def test_null_item_falls_to_else(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (R.OEM_FEE_ITEM, 4)], "i string, v int")
    col = F.when(F.col("i") != F.lit(R.OEM_FEE_ITEM), F.col("v")).otherwise(F.lit(0))
    assert df.agg(F.sum(col)).first()[0] == 1


def test_gl_cost(spark):
    rows = [(R.SELL_GL_ACCOUNT, Decimal("10"), Decimal("3"), Decimal("7")),
            (R.COGS_GL_ACCOUNT, Decimal("10"), Decimal("3"), Decimal("7")),
            ("999", Decimal("10"), Decimal("3"), Decimal("7")),
            (R.SELL_GL_ACCOUNT, Decimal("10"), None, Decimal("7"))]
    df = spark.createDataFrame(rows, "a string, n decimal(18,4), g decimal(18,4), c decimal(18,4)")
    got = [r[0] for r in df.select(R.gl_cost(F.col("a"), F.col("n"), F.col("g"), F.col("c")))
           .collect()]
    assert got == [Decimal("7"), Decimal("7"), Decimal("0"), None]
