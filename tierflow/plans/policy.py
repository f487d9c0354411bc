"""Business constants. Every operator takes them as arguments with these defaults."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: they must equal the business rules for the results to be right.
# ---------------------------------------------------------------------------

TIERS = ("A", "B", "C", "D", "E")
MISSING_TIER = "Missing Data"

# service level in percent by proposed tier
SERVICE_LEVELS = {"A": 99.2, "B": 99.0, "C": 98.0, "D": 85.0, "E": 80.0}
SERVICE_LEVEL_UNKNOWN = 99999.0

# coverage weeks by (import flag, cube), then by tier A, B, C, D, E
COVERAGE_WEEKS = {
    ("Domestic", "Low"): (4, 4, 3, 3, 3),
    ("Domestic", "High"): (3, 3, 3, 3, 0),
    ("Import", "Low"): (6, 6, 4, 3, 3),
    ("Import", "High"): (4, 4, 3, 3, 3),
}

# product categories that take much room
HIGH_CUBE_CATEGORIES = (
    "Printing Supplies",
    "Paper Product",
    "Refrigerators",
    "Laundry",
    "Ovens",
    "Water Heaters",
    "Ice Machines",
    "Condensing Units",
    "Safety Storage",
    "Dishwashers",
    "Shower Doors, Tubs &Enclosures",
    "Banquet Furniture",
    "Trucks & Carts",
    "Compact Appliances",
    "GuestRoom Case Goods&Furniture",
    "Pre-hung Int. Doors",
    "Wheelchairs & Walkers",
    "Air Handlers, Furnaces & Coils",
    "Pool&Patio Furniture",
    "Shelving & Storage",
    "PTAC & Ductless (Mini Splits)",
    "Hospitality Beds",
    "Exterior Doors",
    "Bellmans Carts & Accessories",
    "Snow & Ice Removal Equipment",
    "Wall Air Conditioners",
    "Microwaves",
    "Bypass Doors",
    "Pillows And Protectors",
    "Bathroom Vanities",
    "Fab - Countertops",
    "Waste Receptacles And Liners",
    "Ladders & Ladder Acc.",
    "Mattress Pads Covers Toppers",
    "Carts & Receptacles",
    "Window Air Conditioners",
    "Thru-The-Wall Condensers",
    "Kitchen Cabinets",
    "Brand Standards Linen",
    "Toilets",
    "Towels",
    "Recycling Kits",
    "Lumber",
    "Blankets",
    "Storage Containers & Shelving",
    "Healthcare Furniture",
    "Portable Air Conditoners",
    "Air Filtration",
    "Fab-Interior Slab Bypass Doors",
    "Foil",
    "Fab - Kitchen Cabinets",
)

# order lines that count for the average price
PRICE_ORDER_TYPES = ("ZCTR", "ZGOV", "ZOR", "ZPIR", "ZHP")
PRICE_EXCLUDED_LINE_CATEGORIES = ("ZTAS",)
PRICE_REJECT_CODES = ("", "ZF", "ZL")
PRICE_EXCLUDED_SHIP_POINTS = ("GA07", "TX76")

# catalogue rows kept out of the material network
EXCLUDED_PLANTS = ("GA07", "MN43")
EXCLUDED_PLANT_PREFIX = "ZZ"
EXCLUDED_VENDORS = ("28126", "27191", "28511", "28956", "28302", "")
EXCLUDED_ITEM_TYPE = "ZNFS"
EXCLUDED_CATEGORY_KEYS = ("29", "35", "36", "37")
EXCLUDED_PRODUCT_KEYS = (
    "103101", "103821", "151150", "151200",
    "303236", "305518", "305521", "305522", "305524", "305526",
    "339150", "338403", "338402", "339140", "339120", "339103",
)

# warehouses kept out of the usn network
EXCLUDED_WAREHOUSES = (
    "701", "702", "226", "229", "235", "177", "304", "372",
    "49", "295", "409", "371", "107", "354",
)
VENDOR_MANAGED_REGIONS = ("VMI", "Unknown Region")
ACTIVE_ASSORTMENT = "REPLENISHED"

# location numbers that are distribution centres
LOCATION_RANGE = (3211, 3721)

# item, category and usn that replace the item master's
ITEM_OVERRIDES = (("281259", "Kitchen & Bath", "97853"),)

# supplier codes that always mean consolidation
CONSOLIDATED_SUPPLIERS = ("8000105C", "8000143C", "8000072C", "8000059C")

MOVE_COMPLETE = "Complete"

# reason texts
REASON_RANKED = "Velocity Tier A-D Driver: Forecasted/Core/Superseded"
REASON_NEW_FORECASTED = "Velocity Tier C Driver: Forecasted/New/Not Superseded"
REASON_NEW_UNFORECASTED = "Velocity Tier C Driver: Not Forecasted/New"
REASON_IDLE = "Velocity Tier E Driver: Not Forecasted/Not New"
REASON_OTHER = "Other or Unclassified"

# upload and state-report headers
UPLOAD_KEYS = ("JDA_ITEM", "JDA_LOC")
PROPOSED_HEADERS = (
    "PROPOSED_VELOCITY",
    "PROPOSED_VELOCITY_",
    "PROPOSED_VELOCITY__",
    "PROPOSED VELOCITY",
    "PROPOSED VELOCITY_",
)
STATE_HEADERS = ("ITEM", "DC NUMBER", "VELOCITY")
STATE_DETAIL_HEADERS = (
    "ITEM DESCRIPTION",
    "VENDOR NUMBER",
    "VENDOR NAME",
    "DC NAME",
    "ANALYST",
    "MCAT",
    "PCAT",
    "IMPORT FLAG",
    "First Receipt Flag",
    "Source Type",
)
STATE_SHEET = "TW Data"

# impact transitions
STAYED = "Stayed New+Forecasted"
TO_RANKED = "Transitioned to Not New+Forecasted"
TO_NEW_UNFORECASTED = "Changed to New+Not Forecasted"
TO_IDLE = "Transitioned to Not New+Not Forecasted"
DROPPED = "Dropped from universe"
OTHER_TRANSITION = "Other"
TRANSITIONS = (STAYED, TO_RANKED, TO_NEW_UNFORECASTED, TO_IDLE, DROPPED, OTHER_TRANSITION)

# lists of lookup rows that the active universe may carry, by the operator that unfolds them
FLAG_LIST, ORDER_LIST = "__item_flags", "__orders"
OWN_DATES, CROSS_DATES = "__own_dates", "__cross_dates"
CARRIED_LISTS = (FLAG_LIST, ORDER_LIST, OWN_DATES, CROSS_DATES)
# the forecast of a row's location and item, which the usn universe may carry for the forecast attach
CARRIED_FORECAST = "__forecast"

#: Catalogue rows of one part of the joins by item and dc, and the size up to which Spark chooses the parts.
ROWS_PER_PART, FEW_ROWS = 100_000, 1_000_000
