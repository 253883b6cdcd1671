"""The rules' fixed values, pinned: the oracle reads the same lists, so a slip in one would not show there."""

import pytest

from devicelens.functions import rules as R

# Fixed values of the reports.
PINNED = {
    "DEPOTS": ('00373', '18885', '04362', '00882', '10415', '19142', '19112', '00883', '00301', '18441'),
    "INTERNAL_SITES": ('10415', '00060', '00373', '00883', '18441', '18885', '19112', '19142', '00301', '05549', '00882', '04362'),
    "TRACED_SOURCES": ('00000', '00060', '00072', '00249', '00301', '00373', '00475', '00784', '00882', '00883', '00920', '01045',
         '01244', '01666', '01672', '03107', '03807', '04362', '04896', '05133', '05134', '05135', '05136', '05137',
         '05351', '05549', '05636', '06586', '06719', '06825', '08644', '10415', '11777', '11935', '12354', '12412',
         '12706', '12708', '14371', '14372', '14394', '15454', '16545', '16890', '16891', '16892', '16894', '16898',
         '16901', '16904', '16907', '18376', '18441', '18644', '18645', '18685', '18885', '18941', '19054', '19057',
         '19112', '19142', '19158', '19285', '19509', '19562', '19671', '20276', '26897'),
    "PM_SITES": ('19142', '19112', '00883', '00301'),
    "OWN_PARENT": 108,
    "DEVICE_TYPES": ('Pump', 'Pump - Ambulatory', 'Pump - Enteral', 'Pump - Pole Mounted', 'Pump - Pole Mounted Infusion',
         'Pump, Infusion', 'Pump - Syringe', 'Ventilator', 'DME-Ventilator', 'Anesthesia Ventilator',
         'Pulse Oximeter', 'Respiratory', 'Simulator, Pulse Oximeter', 'DME-Pulse Oximeter', 'Monitor, Video',
         'Humidifier', 'DME-Humidifier', 'DME-Apnea Monitor', 'DME-In-Exsufflator', 'Nebulizer',
         'DME-Hand Dynamometer', 'Pharmacy Compounders', 'Centrifuge', 'DME-CPAP'),
    "ENTERAL_TYPES": ('Pump - Enteral',),
    "INFUSION_TYPES": ('Pump - Ambulatory', 'Pump - Syringe', 'Pump - Pole Mounted', 'Pump - Pole Mounted Infusion',
         'Pump, Infusion'),
    "VENTILATOR_TYPES": ('Ventilator', 'DME-Ventilator', 'Anesthesia Ventilator'),
    "OTHER_DEVICE_TYPES": ('Pulse Oximeter', 'Respiratory', 'Simulator, Pulse Oximeter', 'DME-Pulse Oximeter', 'Monitor, Video', 'Pump',
         'Humidifier', 'DME-Humidifier', 'DME-Apnea Monitor', 'DME-In-Exsufflator', 'Nebulizer',
         'DME-Hand Dynamometer', 'Pharmacy Compounders', 'Centrifuge', 'DME-CPAP'),
    "TOP_DEVICE_CODES": ('556', '139', '4863', '5950', '5958', '10418', '10653', '10907', '8667', '4597', '489', '921', '8225', '510',
         '4595', '8226', '2054', '280', '9009', '6850', '6267', '7749', '8890'),
    "CHECK_IN_CODE": 1,
    "CLEANED_CODE": 2,
    "PM_CODES": (3, 33),
    "REPAIR_CODE": 924,
    "SHIP_CODES": (4, 6, 8, 66, 301, 508, 666),
    "RELOCATION_CODE": 903,
    "PLACEMENT_CODE": 4,
    "TRANSFER_CODE": 8,
    "ACTIVITY_CODES": (3, 33, 924, 2, 4, 6, 8, 66, 301, 508, 666, 903),
    "SOURCE_COUNT_CODES": (3, 33, 924, 2, 4, 6, 8, 66, 301, 508, 666),
    "SHIP_OR_CLEAN_CODES": (2, 4, 6, 8, 66, 301, 508, 666),
    "FREIGHT_ITEMS": ('1167563', '1066182', '307728'),
    "VERBAL_CARE_ITEMS": ('1151926', '1151927'),
    "ONETRACK_ITEMS": ('1167552', '1167881', '1167883', '1167555'),
    "SERVICE_CUSTOMERS": ('65296447',),
    "PPPM_BILL_TO": ('66050515',),
    "PPPM_ITEMS": ('1167556',),
    "NEW_LINE_TYPES": ('B4',),
    "USED_LINE_TYPES": ('B5',),
    "RENTAL_LINE_TYPES": ('B3',),
    "NEW_SUB_CATEGORIES": ('Feeding Pumps- New', 'Infusion Pumps- New', 'Vents - New'),
    "NEW_SUB_CATEGORY_PREFIX": 'Infusion Pumps - New',
    "USED_SUB_CATEGORIES": ('Infusion Pumps- Used', 'Vents - Used', 'Feeding Pumps- Used', 'Nebulizer Compressor (equipment) USED',
         'Apnea Monitors, Used', 'Accessories, Ventilators, Used', 'Breast Pumps & Accessories, USED',
         'Pulse Oximeter, Respiratory, Used', 'Re-Supply, Circuit Assembly, USED',
         'Other Iv Therapy, N/S Accessories, Used', 'Humidifiers, Used', 'Feeding Pump Components, Used',
         'Infusion Pump Accessories- Used', 'All Other Office Supplies, Tech, Used', 'Vent Humidifiers- Used',
         'Miscellaneous Respiratory, Used', 'Instrument Batteries, Used'),
    "USED_SUB_CATEGORY_PREFIX": 'Infusion Pumps - Used',
    "USED_ITEMS": ('1163161', '1163164', '1170554', '1163361', '1163469', '1163620', '1163163', '1163389', '1163390', '1162608',
         '1168187', '1168186'),
    "RENTAL_ITEMS": ('1167548', '1167546', '1170550', '1170555', '1200820', '1200868', '1200902', '1200926'),
    "RENTAL_SUB_CATEGORIES": ('Feeding Pumps - Rentals', 'Infusion Pumps - Rentals', 'Vents - Rentals', 'Rental Fee Other',
         'Rental Iv Pumps, Other', 'Infusion Pumps - Rentals AMB', 'Infusion Pumps - Rentals SYRINGE',
         'Infusion Pumps - Rentals LVP'),
    "OEM_FEE_ITEM": '1167566',
    "SERVICE_FEE_ITEMS": ('1167556', '1167564', '1167565', '1167545', '1167541', '1167562'),
    "SELL_GL_ACCOUNT": '411010',
    "COGS_GL_ACCOUNT": '414021',
    "DIVISIONS": (('06', 'HME'), ('10', 'PAC'), ('45', 'HIT'), ('36', 'SIMPLY MED')),
    "DIVISION_DEFAULT": 'other',
    "SPECIALIST_TYPES": ('EBO', 'PBO'),
    "GROUP_NAME_TRIMS": ('BIO-', 'BIO - ', 'BIO '),
    "OWN_LABEL": 'Company Owned',
    "CUSTOMER_OWNED_LABEL": 'Customer Owned',
    "TRANSFER_LABEL": 'Transfer to Company',
}


@pytest.mark.parametrize("name", sorted(PINNED))
def test_fixed_values(name):
    assert getattr(R, name) == PINNED[name]
