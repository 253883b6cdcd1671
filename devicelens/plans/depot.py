"""Device-service jobs: depot activity, shipment audits, turnaround, rosters.

Every date window is a half-open ``[start, end)`` range on the event
timestamp written as typed literals, so the predicate reaches the parquet
scan. Jobs join the event log to small site/staff dimensions first (the
selective joins), then to devices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.functions import rules as R
from devicelens.functions.dates import business_days, month_range, ts_lit
from devicelens.operators.joins import after_latest, latest_per_key
from devicelens.sources.catalog import Tables


def _now(as_of):
    return ts_lit(as_of) if as_of is not None else F.current_timestamp().cast("timestamp_ntz")


def _codes(t: Tables) -> DataFrame:
    """Event-code lookup."""
    return t["event_codes"]


def _staff_at(t: Tables, sites) -> DataFrame:
    """Associates whose client is one of ``sites``, with the site name."""
    a = t["associates"].select("UserId", "FK_ClientId", F.col("Name").alias("techName"))
    c1 = (t["clients"].where(F.col("ID").isin(list(sites)))
          .select(F.col("PK_ClientId"), F.col("ID").alias("tech_site"),
                  F.col("Name").alias("LocationName")))
    return a.join(c1, a.FK_ClientId == c1.PK_ClientId, "inner").drop("PK_ClientId")


# ---------------------------------------------------------------------------
# Depot activity (distinct activity rows counted per month, site, ownership)
# ---------------------------------------------------------------------------

def activity_rows(t: Tables, *, start="2024-11-01", end="2024-12-01", depots=R.DEPOTS,
                  own_parent=R.OWN_PARENT, own_label=R.OWN_LABEL,
                  codes=R.ACTIVITY_CODES) -> DataFrame:
    """One activity row per event of ``codes`` in ``[start, end)`` by staff of
    ``depots``: device, owner, classes, event type, technician, site, year,
    month (no event id or timestamp)."""
    e = (t["events"]
         .where(F.col("EventCode").isin(list(codes))
                & (F.col("TimeStamp") >= ts_lit(start)) & (F.col("TimeStamp") < ts_lit(end)))
         .select("BarCodeNumber", "EventCode", "SrcID", "DestID", "TimeStamp", "FK_UserId"))
    e = e.join(_codes(t).select("Code"), e.EventCode == F.col("Code"), "inner")
    staff = _staff_at(t, depots)
    e = e.join(staff, e.FK_UserId == staff.UserId, "inner")
    q = t["devices"].select("DeviceCode", F.col("BarCodeNumber").alias("q_barcode"), "Make",
                            "Model", "Owner", "OwnerID", "DeviceType")
    e = e.join(q, e.BarCodeNumber == q.q_barcode, "inner")
    c = t["clients"].select(F.col("ID").alias("owner_id"),
                            F.col("FK_ParentCompanyId").alias("owner_parent"))
    e = e.join(c, e.OwnerID == c.owner_id, "inner")
    return e.select(
        "DeviceCode", "BarCodeNumber", "Make", "Model", "Owner", "OwnerID",
        R.ownership(F.col("owner_parent"), own_parent, own_label).alias("ownershipType"),
        R.top_device(F.col("DeviceCode")).alias("top_device"),
        R.device_class(F.col("DeviceType")).alias("deviceType_homemade"),
        R.device_class_lvl2(F.col("DeviceType")).alias("deviceType_homemade_lvl2"),
        R.event_type(F.col("EventCode"), F.col("SrcID"), F.col("DestID"), depots)
        .alias("eventType"),
        F.lit(1).alias("rowcounter"), "techName", "LocationName",
        F.year("TimeStamp").alias("eventYear"), F.month("TimeStamp").alias("eventMonth"),
    )


def depot_activity(t: Tables, *, start="2024-11-01", end="2024-12-01", depots=R.DEPOTS,
                   own_parent=R.OWN_PARENT, own_label=R.OWN_LABEL, dedupe=True) -> DataFrame:
    """Activity counts by year, month, site, ownership type and event type.

    ``dedupe=True`` counts distinct activity rows (two PMs of one device by
    one technician in one month count once); ``dedupe=False`` counts events.
    The distinct shuffle is keyed by the full row (well spread); the small
    final count is pre-aggregated per map task before its own shuffle.
    """
    rows = activity_rows(t, start=start, end=end, depots=depots, own_parent=own_parent,
                         own_label=own_label)
    if dedupe:
        rows = rows.distinct()
    return (rows.groupBy("eventYear", "eventMonth", "LocationName", "ownershipType", "eventType")
            .agg(F.sum("rowcounter").cast("long").alias("eventCount")))


# ---------------------------------------------------------------------------
# Pool relocation audit, source counts, pool list, rosters
# ---------------------------------------------------------------------------

def pool_locations(t: Tables, pattern: str = "%pool%") -> DataFrame:
    """Distinct (ID, Name) of clients whose name matches ``pattern``
    case-insensitively."""
    return t["clients"].where(F.col("Name").ilike(pattern)).select("ID", "Name").distinct()


def lookup(t: Tables, table: str, predicate, order_by, n: int = 100) -> DataFrame:
    """First ``n`` rows of a logical table matching ``predicate`` (a Column).

    Rows are ordered by ``order_by``, a unique key of the table (one column
    or several), so the rows kept are fixed; Spark plans this as a top-k
    (TakeOrderedAndProject), each task keeping at most ``n`` rows.
    """
    df = t[table].where(predicate)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def pool_shipments(t: Tables, *, depots=R.DEPOTS, pattern: str = "%pool%",
                   codes=R.SHIP_CODES) -> DataFrame:
    """Ship events by depot staff whose source is a pool client, counted per
    code, description, source, destination and event type."""
    e = (t["events"].where(F.col("EventCode").isin(list(codes)))
         .select("EventCode", "SrcID", "DestID", "FK_UserId"))
    pools = t["clients"].where(F.col("Name").ilike(pattern)).select(F.col("ID").alias("pool_id"))
    e = e.join(pools, e.SrcID == pools.pool_id, "left_semi")
    e = e.join(_codes(t), e.EventCode == F.col("Code"), "inner")
    staff = _staff_at(t, depots).select("UserId")
    e = e.join(staff, e.FK_UserId == staff.UserId, "inner")
    etype = R.event_type(F.col("EventCode"), F.col("SrcID"), F.col("DestID"), depots,
                         with_relocation=False)
    return (e.withColumn("eventType", etype)
            .groupBy("Code", "Description", "SrcID", "DestID", "eventType")
            .agg(F.count(F.lit(1)).alias("event_count")))


def source_counts(t: Tables, *, since="2022-12-31", codes=R.SOURCE_COUNT_CODES) -> DataFrame:
    """Events of ``codes`` after ``since`` counted per source location."""
    return (t["events"]
            .where(F.col("EventCode").isin(list(codes)) & (F.col("TimeStamp") > ts_lit(since)))
            .groupBy("SrcID").agg(F.count(F.lit(1)).alias("event_count")))


def technicians(t: Tables, depots=R.DEPOTS) -> DataFrame:
    """Staff of the depot locations."""
    a = t["associates"]
    c1 = t["clients"].where(F.col("ID").isin(list(depots)))
    return a.join(c1, a.FK_ClientId == c1.PK_ClientId, "inner").select(
        a.Name.alias("techName"), a.UserId, a.Eid, a.ClientID, c1.Name.alias("LocationName"))


def staff_at(t: Tables, pattern: str = "%field service%") -> DataFrame:
    """Associates with a login (Eid) at clients whose name matches ``pattern``."""
    a = t["associates"].where(F.col("Eid").isNotNull())
    c = t["clients"].where(F.col("Name").ilike(pattern))
    return a.join(c, a.FK_ClientId == c.PK_ClientId, "inner").select(
        a.Name.alias("techName"), c.Name.alias("clientName"), a.ID, a.UserId, a.Eid)


def client_lookup(t: Tables, key: str = "00883", n: int = 100) -> DataFrame:
    """First ``n`` clients (by primary key) whose id or primary key is ``key``.

    The primary key is numeric, so ``key`` is compared as a number there
    (``'00883'`` matches primary key 883). The key column leads the output.
    """
    c = t["clients"]
    cond = F.col("ID") == F.lit(key)
    if key.strip().lstrip("-").isdigit():
        cond = cond | (F.col("PK_ClientId") == F.lit(int(key)))
    rest = [x for x in c.columns if x != "PK_ClientId"]
    return c.where(cond).select("PK_ClientId", *rest).orderBy("PK_ClientId").limit(n)


def associate_lookup(t: Tables, client_id: str = "00883", n: int = 100) -> DataFrame:
    """First ``n`` associates (by user id) of client ``client_id``."""
    a = t["associates"]
    lead = ["ID", "ClientID", "FK_ClientId"]
    rest = [x for x in a.columns if x not in lead]
    return (a.where(F.col("ClientID") == F.lit(client_id)).select(*lead, *rest)
            .orderBy("UserId").limit(n))


def active_sources(t: Tables, *, start="2024-12-01", end="2025-01-01",
                   own_parent=R.OWN_PARENT, codes=R.SHIP_OR_CLEAN_CODES) -> DataFrame:
    """Distinct own-company source sites with shipping/cleaning events in
    ``[start, end)``."""
    e = (t["events"]
         .where(F.col("EventCode").isin(list(codes))
                & (F.col("TimeStamp") >= ts_lit(start)) & (F.col("TimeStamp") < ts_lit(end)))
         .select("EventCode", "SrcID"))
    e = e.join(_codes(t).select("Code"), e.EventCode == F.col("Code"), "inner")
    src = (t["clients"].where(F.col("FK_ParentCompanyId") == F.lit(own_parent))
           .select(F.col("ID").alias("src_id"), F.col("Name").alias("source_name")))
    return e.join(src, e.SrcID == src.src_id, "inner").select("SrcID", "source_name").distinct()


# ---------------------------------------------------------------------------
# Check-ins and turnaround
# ---------------------------------------------------------------------------

def check_ins(t: Tables, own_parent=R.OWN_PARENT) -> DataFrame:
    """Check-in events whose destination belongs to the own parent company."""
    e = (t["events"].where(F.col("EventCode") == F.lit(R.CHECK_IN_CODE))
         .select("BarCodeNumber", "EventCode", "DestID", "TimeStamp"))
    e = e.join(_codes(t), e.EventCode == F.col("Code"), "inner")
    own = (t["clients"].where(F.col("FK_ParentCompanyId") == F.lit(own_parent))
           .select(F.col("ID").alias("dest_id")))
    return (e.join(own, e.DestID == own.dest_id, "inner")
            .select("BarCodeNumber", "EventCode", "Description", "TimeStamp"))


def checkin_latest(t: Tables, own_parent=R.OWN_PARENT) -> DataFrame:
    """Latest own-site check-in per barcode (BarCodeNumber, checkInTime)."""
    return latest_per_key(check_ins(t, own_parent), "BarCodeNumber", "TimeStamp", "checkInTime")


_REP_KEYS = ("BarCodeNumber", "FK_DeviceId", "Status", "DateOpened", "FK_RepairPerformedById",
             "techName", "locationName", "FK_ClientId", "PK_ClientId", "ID", "PerformedAt",
             "RepairTicketNo", "PK_RepairTicketId", "DateLastModified", "PK_RMATrackerId",
             "VendorRMANumber", "RepairedBy", "RepairType")


def completed_repairs(t: Tables, *, since="2022-01-01", as_of=None, sites=None) -> DataFrame:
    """Last completion per ticket attribute set, ``since < completed < as_of``.

    ``sites`` optionally restricts ``PerformedAt`` (a group key, so the
    filter is applied before the grouping).
    """
    r = t["repair_tickets"].where(
        F.col("DateRepairCompleted").isNotNull()
        & (F.col("DateRepairCompleted") > ts_lit(since))
        & (F.col("DateRepairCompleted") < _now(as_of)))
    if sites is not None:
        r = r.where(F.col("PerformedAt").isin(list(sites)))
    r7 = t["rma_tracker"].select("PK_RMATrackerId", "FK_RepairTicketId")
    a = t["associates"].select(F.col("UserId").alias("a_user"), F.col("Name").alias("techName"),
                               "FK_ClientId")
    c = t["clients"].select(F.col("ID"), F.col("PK_ClientId"),
                            F.col("Name").alias("locationName"))
    j = (r.join(r7, r.PK_RepairTicketId == r7.FK_RepairTicketId, "left")
         .join(a, r.FK_RepairPerformedById == a.a_user, "left")
         .join(c, r.PerformedAt == c.ID, "left"))
    return j.groupBy(*_REP_KEYS).agg(F.max("DateRepairCompleted").alias("DateRepairCompleted"))


def repair_turnaround(t: Tables, *, since="2022-01-01", as_of=None, depots=R.DEPOTS,
                      own_parent=R.OWN_PARENT) -> DataFrame:
    """Business days from a device's latest own-site check-in to each later
    repair completion, for repairs performed at ``depots``.

    Tickets completed before the device's latest check-in are dropped.
    """
    reps = completed_repairs(t, since=since, as_of=as_of, sites=depots)
    latest = checkin_latest(t, own_parent)
    j = after_latest(reps, latest, "BarCodeNumber", "DateRepairCompleted", "checkInTime")
    q = t["devices"].select(F.col("DeviceUID"), F.col("BarCodeNumber").alias("q_barcode"),
                            "StatusDescription", "StatusCode")
    j = j.join(q, j.FK_DeviceId == q.DeviceUID, "inner")
    return j.select(
        F.col("q_barcode").alias("BarCodeNumber"), "StatusDescription", "StatusCode",
        F.month("checkInTime").alias("checkIn_month"), F.year("checkInTime").alias("checkIn_year"),
        F.month("DateRepairCompleted").alias("completed_month"),
        F.year("DateRepairCompleted").alias("completed_year"),
        "FK_DeviceId", "Status", "DateOpened", "FK_RepairPerformedById", "techName",
        "locationName", "PerformedAt", "RepairTicketNo", "PK_RepairTicketId", "DateLastModified",
        "PK_RMATrackerId", "VendorRMANumber", "RepairedBy", "RepairType", "DateRepairCompleted",
        business_days(F.col("checkInTime"), F.col("DateRepairCompleted")).alias("repairDays"),
    )


def turnaround_summary(t: Tables, **kw) -> DataFrame:
    """Average repair business days by completion month, location and site."""
    return (repair_turnaround(t, **kw)
            .groupBy("completed_month", "completed_year", "locationName", "PerformedAt")
            .agg(F.avg("repairDays").alias("repairDays_avg"),
                 F.count(F.lit(1)).alias("repair_count")))


def pm_completions(t: Tables, *, year=2024, month=12, sites=R.PM_SITES) -> DataFrame:
    """PM events in one month by staff of ``sites``, with the site name."""
    start, end = month_range(year, month)
    e = (t["events"]
         .where(F.col("EventCode").isin(list(R.PM_CODES))
                & (F.col("TimeStamp") >= ts_lit(start)) & (F.col("TimeStamp") < ts_lit(end)))
         .select("BarCodeNumber", "EventCode", "TimeStamp", "FK_UserId"))
    staff = _staff_at(t, sites).select("UserId", F.col("LocationName").alias("techLocationName"))
    # Semi-join first (kept in place) so only PM-site staff events go on to
    # the check-in and device joins.
    e = e.join(staff.select(F.col("UserId").alias("staff_user")),
               e.FK_UserId == F.col("staff_user"), "left_semi")
    e = e.join(staff, e.FK_UserId == staff.UserId, "inner")
    e = e.join(_codes(t), e.EventCode == F.col("Code"), "inner")
    return e.select("BarCodeNumber", "EventCode", "Description",
                    F.col("TimeStamp").alias("pmCompletedDate"), "techLocationName")


def pm_turnaround(t: Tables, *, year=2024, month=12, sites=R.PM_SITES, own_parent=R.OWN_PARENT,
                  since="2022-01-01", as_of=None) -> DataFrame:
    """PM completions after the device's latest own-site check-in, with the
    business-day duration (``PmDays``)."""
    p = pm_completions(t, year=year, month=month, sites=sites)
    p = p.where((F.col("pmCompletedDate") > ts_lit(since))
                & (F.col("pmCompletedDate") < _now(as_of)))
    latest = checkin_latest(t, own_parent)
    j = after_latest(p, latest, "BarCodeNumber", "pmCompletedDate", "checkInTime")
    q = t["devices"].select(F.col("BarCodeNumber").alias("q_barcode"))
    j = j.join(q, j.BarCodeNumber == q.q_barcode, "inner")
    return j.select(
        "checkInTime", "pmCompletedDate", "techLocationName",
        F.month("pmCompletedDate").alias("completed_month"),
        F.year("pmCompletedDate").alias("completed_year"),
        business_days(F.col("checkInTime"), F.col("pmCompletedDate")).alias("PmDays"))


def pm_volume(t: Tables, *, year=2024, month=12, sites=R.PM_SITES, own_parent=R.OWN_PARENT,
              since="2022-01-01", as_of=None, with_avg: bool = False) -> DataFrame:
    """PM count by month, year and technician location; ``with_avg`` adds the
    average business days from check-in (``PmDays_avg``)."""
    aggs = [F.count(F.lit(1)).alias("pm_count")]
    if with_avg:
        aggs.append(F.avg("PmDays").alias("PmDays_avg"))
    return (pm_turnaround(t, year=year, month=month, sites=sites, own_parent=own_parent,
                          since=since, as_of=as_of)
            .groupBy("completed_month", "completed_year", "techLocationName")
            .agg(*aggs))


def depot_activity_detail(t: Tables, **kw) -> DataFrame:
    """The distinct activity rows the depot activity counts."""
    return activity_rows(t, **kw).distinct()


def ticket_business_days(t: Tables) -> DataFrame:
    """Business days from opening to completion of every repair ticket
    (0 while open)."""
    return t["repair_tickets"].select(
        "PK_RepairTicketId", "DateOpened", "DateRepairCompleted",
        business_days(F.col("DateOpened"), F.col("DateRepairCompleted")).alias("businessDays"))
