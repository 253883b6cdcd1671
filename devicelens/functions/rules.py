"""Business rules as data, compiled to native Spark Column expressions.

Every rule is a chain of ``F.when`` branches whose order matters; no Python
UDF is involved, so Catalyst keeps the whole classification inside
whole-stage codegen and large ``isin`` lists become ``InSet`` lookups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source rules exactly for the reports to
# match; they are listed plainly and in their original order.
# ---------------------------------------------------------------------------

# Depot locations (client ids) used by the service metrics.
DEPOTS = ("00373", "18885", "04362", "00882", "10415", "19142", "19112", "00883",
          "00301", "18441")

# Internal sites for the placement sale/rental label.
INTERNAL_SITES = ("10415", "00060", "00373", "00883", "18441", "18885", "19112", "19142",
                  "00301", "05549", "00882", "04362")

# Source locations whose outbound events are traced as placements.
TRACED_SOURCES = (
    "00000", "00060", "00072", "00249", "00301", "00373", "00475", "00784", "00882", "00883",
    "00920", "01045", "01244", "01666", "01672", "03107", "03807", "04362", "04896",
    "05133", "05134", "05135", "05136", "05137", "05351", "05549", "05636", "06586", "06719",
    "06825", "08644", "10415", "11777", "11935", "12354", "12412", "12706", "12708", "14371",
    "14372", "14394", "15454", "16545", "16890", "16891", "16892", "16894", "16898", "16901",
    "16904", "16907", "18376", "18441", "18644", "18645", "18685", "18885", "18941", "19054",
    "19057", "19112", "19142", "19158", "19285", "19509", "19562", "19671", "20276", "26897",
)

# Sites whose preventive-maintenance volume is reported.
PM_SITES = ("19142", "19112", "00883", "00301")

# Parent company id of the operator's own sites.
OWN_PARENT = 108

# Device types counted as devices (everything else is an accessory).
DEVICE_TYPES = (
    "Pump", "Pump - Ambulatory", "Pump - Enteral", "Pump - Pole Mounted",
    "Pump - Pole Mounted Infusion", "Pump, Infusion", "Pump - Syringe", "Ventilator",
    "DME-Ventilator", "Anesthesia Ventilator", "Pulse Oximeter", "Respiratory",
    "Simulator, Pulse Oximeter", "DME-Pulse Oximeter", "Monitor, Video", "Humidifier",
    "DME-Humidifier", "DME-Apnea Monitor", "DME-In-Exsufflator", "Nebulizer",
    "DME-Hand Dynamometer", "Pharmacy Compounders", "Centrifuge", "DME-CPAP",
)
# Device level-2 classes, tested in this order.
ENTERAL_TYPES = ("Pump - Enteral",)
INFUSION_TYPES = ("Pump - Ambulatory", "Pump - Syringe", "Pump - Pole Mounted",
                  "Pump - Pole Mounted Infusion", "Pump, Infusion")
VENTILATOR_TYPES = ("Ventilator", "DME-Ventilator", "Anesthesia Ventilator")
OTHER_DEVICE_TYPES = (
    "Pulse Oximeter", "Respiratory", "Simulator, Pulse Oximeter", "DME-Pulse Oximeter",
    "Monitor, Video", "Pump", "Humidifier", "DME-Humidifier", "DME-Apnea Monitor",
    "DME-In-Exsufflator", "Nebulizer", "DME-Hand Dynamometer", "Pharmacy Compounders",
    "Centrifuge", "DME-CPAP",
)

# Device codes flagged as top devices.
TOP_DEVICE_CODES = ("556", "139", "4863", "5950", "5958", "10418", "10653", "10907", "8667",
                    "4597", "489", "921", "8225", "510", "4595", "8226", "2054", "280", "9009",
                    "6850", "6267", "7749", "8890")

# Event codes.
CHECK_IN_CODE = 1
CLEANED_CODE = 2
PM_CODES = (3, 33)
REPAIR_CODE = 924
SHIP_CODES = (4, 6, 8, 66, 301, 508, 666)
RELOCATION_CODE = 903
PLACEMENT_CODE = 4
TRANSFER_CODE = 8
# Codes selected by the depot activity report.
ACTIVITY_CODES = (3, 33, 924, 2, 4, 6, 8, 66, 301, 508, 666, 903)
# Codes counted per source location.
SOURCE_COUNT_CODES = (3, 33, 924, 2, 4, 6, 8, 66, 301, 508, 666)
# Codes of shipping or cleaning activity.
SHIP_OR_CLEAN_CODES = (2, 4, 6, 8, 66, 301, 508, 666)

# Sales classification.
FREIGHT_ITEMS = ("1167563", "1066182", "307728")
VERBAL_CARE_ITEMS = ("1151926", "1151927")
ONETRACK_ITEMS = ("1167552", "1167881", "1167883", "1167555")
SERVICE_CUSTOMERS = ("65296447",)
PPPM_BILL_TO = ("66050515",)
PPPM_ITEMS = ("1167556",)
NEW_LINE_TYPES = ("B4",)
USED_LINE_TYPES = ("B5",)
RENTAL_LINE_TYPES = ("B3",)
NEW_SUB_CATEGORIES = ("Feeding Pumps- New", "Infusion Pumps- New", "Vents - New")
NEW_SUB_CATEGORY_PREFIX = "Infusion Pumps - New"
USED_SUB_CATEGORIES = (
    "Infusion Pumps- Used", "Vents - Used", "Feeding Pumps- Used",
    "Nebulizer Compressor (equipment) USED", "Apnea Monitors, Used",
    "Accessories, Ventilators, Used", "Breast Pumps & Accessories, USED",
    "Pulse Oximeter, Respiratory, Used", "Re-Supply, Circuit Assembly, USED",
    "Other Iv Therapy, N/S Accessories, Used", "Humidifiers, Used",
    "Feeding Pump Components, Used", "Infusion Pump Accessories- Used",
    "All Other Office Supplies, Tech, Used", "Vent Humidifiers- Used",
    "Miscellaneous Respiratory, Used", "Instrument Batteries, Used",
)
USED_SUB_CATEGORY_PREFIX = "Infusion Pumps - Used"
USED_ITEMS = ("1163161", "1163164", "1170554", "1163361", "1163469", "1163620", "1163163",
              "1163389", "1163390", "1162608", "1168187", "1168186")
RENTAL_ITEMS = ("1167548", "1167546", "1170550", "1170555", "1200820", "1200868", "1200902",
                "1200926")
RENTAL_SUB_CATEGORIES = (
    "Feeding Pumps - Rentals", "Infusion Pumps - Rentals", "Vents - Rentals",
    "Rental Fee Other", "Rental Iv Pumps, Other", "Infusion Pumps - Rentals AMB",
    "Infusion Pumps - Rentals SYRINGE", "Infusion Pumps - Rentals LVP",
)
OEM_FEE_ITEM = "1167566"
SERVICE_FEE_ITEMS = ("1167556", "1167564", "1167565", "1167545", "1167541", "1167562")
SELL_GL_ACCOUNT = "411010"
COGS_GL_ACCOUNT = "414021"
# Sub-class code -> division, tested in this order.
DIVISIONS = (("06", "HME"), ("10", "PAC"), ("45", "HIT"), ("36", "SIMPLY MED"))
DIVISION_DEFAULT = "other"
SPECIALIST_TYPES = ("EBO", "PBO")
# Group-name prefixes removed, in this order, wherever they occur.
GROUP_NAME_TRIMS = ("BIO-", "BIO - ", "BIO ")

# Output labels. The own-company labels are parameters of the jobs; these
# defaults are neutral.
OWN_LABEL = "Company Owned"
CUSTOMER_OWNED_LABEL = "Customer Owned"
TRANSFER_LABEL = "Transfer to Company"


# ---------------------------------------------------------------------------
# Column builders
# ---------------------------------------------------------------------------

def _in(col: Column, values) -> Column:
    return col.isin(list(values))


def device_class(device_type: Column) -> Column:
    """Device vs Accessory by device type."""
    return F.when(_in(device_type, DEVICE_TYPES), F.lit("Device")).otherwise(F.lit("Accessory"))


def device_class_lvl2(device_type: Column) -> Column:
    return (F.when(_in(device_type, ENTERAL_TYPES), device_type)
            .when(_in(device_type, INFUSION_TYPES), F.lit("Pump - Infusion"))
            .when(_in(device_type, VENTILATOR_TYPES), F.lit("Ventilator"))
            .when(_in(device_type, OTHER_DEVICE_TYPES), F.lit("Other"))
            .otherwise(F.lit("Accessory")))


def top_device(device_code: Column, codes=TOP_DEVICE_CODES) -> Column:
    return F.when(_in(device_code, codes), F.lit(1)).otherwise(F.lit(0))


def ownership(parent_id: Column, own_parent: int = OWN_PARENT,
              own_label: str = OWN_LABEL) -> Column:
    return (F.when(parent_id == F.lit(own_parent), F.lit(own_label))
            .otherwise(F.lit(CUSTOMER_OWNED_LABEL)))


def event_type(code: Column, src: Column, dest: Column, depots=DEPOTS,
               with_relocation: bool = True) -> Column:
    """Repair / PM / Shipped / Cleaned, else NULL.

    ``with_relocation`` adds the branch for relocation events that leave a
    depot for a non-depot site (the activity report has it, the pool audit
    does not).
    """
    shipped = _in(code, SHIP_CODES) & _in(src, depots)
    if with_relocation:
        shipped = shipped | ((code == F.lit(RELOCATION_CODE)) & _in(src, depots)
                             & ~_in(dest, depots))
    return (F.when(code == F.lit(REPAIR_CODE), F.lit("Repair"))
            .when(_in(code, PM_CODES), F.lit("PM"))
            .when(shipped, F.lit("Shipped"))
            .when(code == F.lit(CLEANED_CODE), F.lit("Cleaned")))


def sale_rental(src: Column, code: Column, dest: Column, owner_id: Column,
                internal=INTERNAL_SITES, transfer_label: str = TRANSFER_LABEL) -> Column:
    """Sale / Rental / Transfer label of a placement, else NULL.

    ``NOT IN`` keeps SQL three-valued logic: a NULL destination or owner
    makes the branch unknown, so the label stays NULL.
    """
    from_internal = _in(src, internal)
    outbound = from_internal & (code == F.lit(PLACEMENT_CODE)) & ~_in(dest, internal)
    return (F.when(outbound & ~_in(owner_id, internal), F.lit("Sale"))
            .when(outbound & _in(owner_id, internal), F.lit("Rental"))
            .when(from_internal & (code == F.lit(TRANSFER_CODE)) & _in(dest, internal),
                  F.lit(transfer_label)))


def division(sub_class: Column) -> Column:
    expr = None
    for code, name in DIVISIONS:
        cond = sub_class == F.lit(code)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DIVISION_DEFAULT))


def pppm_flag(bill_to: Column, item: Column) -> Column:
    return (F.when(_in(bill_to, PPPM_BILL_TO), F.lit("Y"))
            .when(_in(item, PPPM_ITEMS), F.lit("Y"))
            .otherwise(F.lit("N")))


def _is_new(line_type: Column, sub: Column) -> Column:
    return (_in(line_type, NEW_LINE_TYPES) | _in(sub, NEW_SUB_CATEGORIES)
            | sub.like(NEW_SUB_CATEGORY_PREFIX + "%"))


def _is_used(line_type: Column, sub: Column, item: Column) -> Column:
    return (_in(line_type, USED_LINE_TYPES) | _in(sub, USED_SUB_CATEGORIES)
            | _in(item, USED_ITEMS) | sub.like(USED_SUB_CATEGORY_PREFIX + "%"))


def _is_rental(line_type: Column, sub: Column, item: Column) -> Column:
    return (_in(line_type, RENTAL_LINE_TYPES) | _in(item, RENTAL_ITEMS)
            | _in(sub, RENTAL_SUB_CATEGORIES))


def sales_type(item: Column, customer: Column, line_type: Column, sub: Column) -> Column:
    return (F.when(_in(item, FREIGHT_ITEMS), F.lit("Freight"))
            .when(_in(item, VERBAL_CARE_ITEMS), F.lit("Verbal Care"))
            .when(_in(item, ONETRACK_ITEMS), F.lit("OneTrack"))
            .when(_in(customer, SERVICE_CUSTOMERS), F.lit("Service"))
            .when(_is_new(line_type, sub), F.lit("New Equipment"))
            .when(_is_used(line_type, sub, item), F.lit("Used Equipment"))
            .when(_in(item, PPPM_ITEMS), F.lit("Service"))
            .when(_is_rental(line_type, sub, item), F.lit("Rental"))
            .otherwise(F.lit("Service")))


def consolidated_sales_type(item: Column, customer: Column, line_type: Column,
                            sub: Column) -> Column:
    equipment = _is_new(line_type, sub) | _is_used(line_type, sub, item)
    return (F.when(_in(item, FREIGHT_ITEMS + VERBAL_CARE_ITEMS), F.lit("Other"))
            .when(_in(item, ONETRACK_ITEMS), F.lit("OneTrack"))
            .when(_in(customer, SERVICE_CUSTOMERS) | _in(item, PPPM_ITEMS), F.lit("Service"))
            .when(equipment, F.lit("Equipment"))
            .when(_is_rental(line_type, sub, item), F.lit("Rental"))
            .otherwise(F.lit("Service")))


def gl_cost(gl_account: Column, net: Column, sell_gp: Column, cogs_acq: Column) -> Column:
    """Cost by GL account: sell account -> net minus sell GP; COGS account ->
    acquisition COGS; else 0. NULL inputs propagate (and are then skipped by
    SUM), as in SQL."""
    return (F.when(gl_account == F.lit(SELL_GL_ACCOUNT), net - sell_gp)
            .when(gl_account == F.lit(COGS_GL_ACCOUNT), cogs_acq)
            .otherwise(F.lit(0)))


def group_name_trim(name: Column) -> Column:
    out = name
    for prefix in GROUP_NAME_TRIMS:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return out


def null_as_other(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("Other")).otherwise(col)
