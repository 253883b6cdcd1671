"""Device placement tracing and event history.

Plan shape for :func:`placements` (first outbound event per barcode):

1. events of the placement code from traced sources, joined to devices of
   the requested make (filters reach the scans);
2. ``rank() over (partition by barcode order by ts)`` filtered to 1 right
   away, which Catalyst turns into a partial WindowGroupLimit before the
   shuffle (a hot barcode ships only its first rows);
3. the PO bridge is reduced to devices of the make with a semi-join before
   its DISTINCT, so the bridge work follows those devices, not the whole
   receipt history;
4. dimension joins, receipt filter, label, date window (after the rank, so
   the rank sees every event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.functions import rules as R
from devicelens.functions.dates import month_label, month_name, ts_lit
from devicelens.operators.rank import bucketed_rank, first_by_rank
from devicelens.sources.catalog import Tables

A_COLUMNS = ("SerialNumber", "DeviceCode", "Make", "Model", "Owner", "OwnerID", "Description",
             "TimeStamp", "SrcID", "DestID", "FK_DeviceId", "EventCode", "eventRank",
             "deviceType_homemade", "deviceType_homemade_lvl2")

NO_RECEIPT = "1900-01-01 00:00:00"


def device_classes(t: Tables) -> DataFrame:
    """Device class, level-2 class and top-device flag of every device."""
    q = t["devices"]
    return q.select("DeviceUID", "DeviceCode", "DeviceType",
                    R.device_class(F.col("DeviceType")).alias("deviceType_homemade"),
                    R.device_class_lvl2(F.col("DeviceType")).alias("deviceType_homemade_lvl2"),
                    R.top_device(F.col("DeviceCode")).alias("top_device"))


def _events_of_make(t: Tables, *, make: str, sources, code) -> DataFrame:
    """Events joined to their device (make filter) and code description."""
    e = t["events"].select("BarCodeNumber", "FK_DeviceId", "EventCode", "SrcID", "DestID",
                           "TimeStamp")
    e = e.where(F.col("SrcID").isin(list(sources)))
    if code is not None:
        e = e.where(F.col("EventCode") == F.lit(code))
    q = (t["devices"].where(F.col("Make").ilike(make))
         .select("DeviceUID", "SerialNumber", "DeviceCode", "Make", "Model", "Owner", "OwnerID",
                 "DeviceType"))
    # The make predicate turns the device left join into an inner join.
    e = e.join(q, e.FK_DeviceId == q.DeviceUID, "inner")
    e1 = t["event_codes"]
    return e.join(e1, e.EventCode == e1.Code, "left").drop("Code", "DeviceUID")


def _classify(df: DataFrame) -> DataFrame:
    return (df.withColumn("deviceType_homemade", R.device_class(F.col("DeviceType")))
              .withColumn("deviceType_homemade_lvl2", R.device_class_lvl2(F.col("DeviceType"))))


def first_events(t: Tables, *, make: str = "Breas%", sources=R.TRACED_SOURCES,
                 code=R.PLACEMENT_CODE) -> DataFrame:
    """First qualifying event per barcode (rank 1, ties kept)."""
    e = _events_of_make(t, make=make, sources=sources, code=code)
    ranked = first_by_rank(e, "BarCodeNumber", "TimeStamp", "eventRank")
    return _classify(ranked).select(*A_COLUMNS)


def ranked_events(t: Tables, *, make: str = "Breas%", sources=R.TRACED_SOURCES,
                  code=None, serials=None) -> DataFrame:
    """Every qualifying event with its rank per barcode (skew-safe rank).

    With ``serials``, only barcodes that carry an event of those devices are
    ranked: a rank depends only on events of the same barcode, so the ranks
    are unchanged while the work shrinks to those barcodes. (NULL barcodes
    form one window partition, hence the null-safe match.)
    """
    e = _events_of_make(t, make=make, sources=sources, code=code)
    if serials is not None:
        wanted = (e.where(F.col("SerialNumber").isin(list(serials)))
                  .select(F.col("BarCodeNumber").alias("wanted_barcode")))
        e = e.join(wanted, e.BarCodeNumber.eqNullSafe(wanted.wanted_barcode), "left_semi")
    ranked = bucketed_rank(e, "BarCodeNumber", "TimeStamp", "eventRank")
    return _classify(ranked).select(*A_COLUMNS)


def po_bridge(t: Tables, devices: DataFrame | None = None) -> DataFrame:
    """Distinct (PONumber, receipt id, device code, device id, receipt date).

    With ``devices`` (a frame with ``FK_DeviceId``) only import rows of those
    devices are kept, before the DISTINCT. Receipts without an import row
    carry a NULL device id and can never match a device, so restricting to
    imported receipts (inner join) gives the same matches as the left join.
    """
    rec = t["po_receipts"].select("PONumber", "E1PurchaseOrderReceiptId", "DeviceCode",
                                  "ReceiptDate")
    imp = t["import_history"].select(F.col("E1PurchaseOrderReceiptId").alias("imp_receipt"),
                                     "FK_DeviceId")
    if devices is None:
        j = rec.join(imp, rec.E1PurchaseOrderReceiptId == imp.imp_receipt, "left")
    else:
        imp = imp.join(devices.select(F.col("FK_DeviceId").alias("placed_device")),
                       imp.FK_DeviceId == F.col("placed_device"), "left_semi")
        j = rec.join(imp, rec.E1PurchaseOrderReceiptId == imp.imp_receipt, "inner")
    return j.select("PONumber", "E1PurchaseOrderReceiptId", "DeviceCode", "FK_DeviceId",
                    "ReceiptDate").distinct()


def _devices_of_make(t: Tables, make: str) -> DataFrame:
    return t["devices"].where(F.col("Make").ilike(make)).select(F.col("DeviceUID").alias("FK_DeviceId"))


def _enrich(t: Tables, a: DataFrame, make: str) -> DataFrame:
    """Add part number, PO and receipt, source and end-user details; keep
    end users that are not manufacturers and events after the receipt.

    The PO bridge is reduced to devices of ``make`` (every event in ``a``
    is of that make, so no match is lost) straight from the device table,
    rather than from ``a`` itself, which would compute the ranking twice."""
    oem = t["oem_info"].select("EquipmentTypeId", "PartNumber")
    src = t["clients"].select(F.col("ID").alias("src_id"), F.col("Name").alias("source_name"))
    dest = (t["clients"].where(F.col("Manufacturer") == 0)
            .select(F.col("ID").alias("dest_id"), F.col("Name").alias("End_User_Name"),
                    "Address1", "Address2", "City", "State", "Zip", "E1_AccountNumber"))
    ponum = (po_bridge(t, devices=_devices_of_make(t, make))
             .select(F.col("FK_DeviceId").alias("po_device"), "PONumber", "ReceiptDate"))
    b = (a.join(oem, a.DeviceCode == oem.EquipmentTypeId, "left")
         .join(src, a.SrcID == src.src_id, "left")
         .join(dest, a.DestID == dest.dest_id, "inner")
         .join(ponum, a.FK_DeviceId == ponum.po_device, "left")
         .where(F.col("TimeStamp") > F.coalesce(F.col("ReceiptDate"), ts_lit(NO_RECEIPT))))
    return b.select(
        *A_COLUMNS, "PONumber", "PartNumber",
        F.col("TimeStamp").alias("placement_date"), "ReceiptDate",
        month_label(F.col("TimeStamp")).alias("placement_year_month"),
        month_name(F.col("TimeStamp")).alias("placement_month"),
        F.year("TimeStamp").alias("placement_year"),
        "source_name", "End_User_Name", "Address1", "Address2", "City", "State", "Zip",
        "E1_AccountNumber")


def placements(t: Tables, *, make: str = "Breas%", sources=R.TRACED_SOURCES,
               internal=R.INTERNAL_SITES, start="2024-02-01", end="2025-03-01",
               after_year: int = 2022, transfer_label: str = R.TRANSFER_LABEL) -> DataFrame:
    """First placement of each device with PO, receipt, addresses and its
    Sale / Rental / Transfer label, placed in ``[start, end)`` after
    ``after_year``. The date window applies after the ranking."""
    a = first_events(t, make=make, sources=sources)
    b = _enrich(t, a, make)
    label = R.sale_rental(F.col("SrcID"), F.col("EventCode"), F.col("DestID"), F.col("OwnerID"),
                          internal, transfer_label)
    return (b.withColumn("sale_rental", label)
            .where((F.col("placement_year") > after_year)
                   & (F.col("placement_date") >= ts_lit(start))
                   & (F.col("placement_date") < ts_lit(end))))


def event_history(t: Tables, *, make: str = "Breas%", sources=R.TRACED_SOURCES,
                  serials=("M240187",)) -> DataFrame:
    """All events of devices of ``make`` from traced sources with their rank,
    enrichment and receipt filter; ``serials=None`` keeps every device."""
    a = ranked_events(t, make=make, sources=sources, serials=serials)
    b = _enrich(t, a, make)
    if serials is not None:
        b = b.where(F.col("SerialNumber").isin(list(serials)))
    return b


def placement_labels(t: Tables, **kw) -> DataFrame:
    """Placement counts by month and label."""
    return (placements(t, **kw)
            .groupBy("placement_year_month", "placement_month", "sale_rental")
            .agg(F.count(F.lit(1)).alias("placement_count")))
