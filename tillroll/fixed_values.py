"""Labels, limits and patterns the reports are defined by.

They are part of the result contract (they show up in the output, or decide
which row lands in which group), so they are stated here once, as plain text.
"""

# Order value bands: (label, exclusive upper limit); the last one takes the rest.
REVENUE_BANDS = (
    ("Low (0-50)", 50),
    ("Medium (50-100)", 100),
    ("High (100-200)", 200),
    ("Premium (200+)", None),
)

# Day names, index 0 = Sunday.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Seasons by calendar month.
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}

# Sales regions by state; every other state (or none) is OTHER_REGION.
REGION_STATES = {
    "West": ("CA", "OR", "WA"),
    "Southwest": ("TX", "AZ", "NM", "OK"),
    "Northeast": ("NY", "NJ", "CT", "MA", "PA"),
    "Southeast": ("FL", "GA", "SC", "NC", "VA"),
}
OTHER_REGION = "Other"

# RFM segments, first match wins. Each rule gives the inclusive (low, high)
# score range for recency, frequency and monetary value.
RFM_TILES = 5
RFM_SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (3, 5), (3, 5), (3, 5)),
    ("Potential Loyalists", (3, 5), (1, 2), (3, 5)),
    ("New Customers", (4, 5), (1, 2), (1, 2)),
    ("At Risk", (1, 2), (3, 5), (3, 5)),
    ("Cannot Lose Them", (1, 2), (1, 2), (3, 5)),
    ("Hibernating", (1, 2), (1, 2), (1, 2)),
)
RFM_OTHER = "Others"

# Churn risk: (label, days since the last order must exceed this).
CHURN_RISKS = (("High Risk", 180), ("Medium Risk", 90), ("Low Risk", 30))
CHURN_ACTIVE = "Active"

# Customer types: (label, inclusive upper limit on the order count).
CUSTOMER_TYPES = (("One-time", 1), ("Occasional", 3), ("Regular", 10))
CUSTOMER_FREQUENT = "Frequent"

# Report age bands: (label, exclusive upper limit).
AGE_BANDS = (
    ("18-24", 25),
    ("25-34", 35),
    ("35-44", 45),
    ("45-54", 55),
    ("55-64", 65),
    ("65+", None),
)

# Age groups of cleaned rows: (label, exclusive lower limit, inclusive upper limit).
CLEAN_AGE_GROUPS = (
    ("18-25", 0, 25),
    ("26-35", 25, 35),
    ("36-50", 35, 50),
    ("51-65", 50, 65),
    ("65+", 65, 100),
)

REPORTED_GENDERS = ("Male", "Female")

# Report limits.
TOP_CUSTOMERS = 20
TOP_CLV = 50
TOP_PRODUCTS = 20
TOP_PAIRS = 20
TOP_CITIES = 20
TOP_PROFIT = 20
MIN_PAIR_ORDERS = 5
MIN_CITY_ORDERS = 10
MIN_UNITS_SOLD = 10
DAYS_PER_YEAR = 365

# Cleaning.
CRITICAL_COLUMNS = ("order_id", "customer_id", "order_date", "total_amount")
POSITIVE_COLUMNS = ("quantity", "unit_price", "total_amount")
UNKNOWN = "Unknown"
OUTLIER_SIGMAS = 3
GENDER_MAP = {
    "M": "Male",
    "m": "Male",
    "male": "Male",
    "MALE": "Male",
    "F": "Female",
    "f": "Female",
    "female": "Female",
    "FEMALE": "Female",
}
GENDER_MAP_WITH_IDENTITY = {**GENDER_MAP, "Male": "Male", "Female": "Female"}
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Text that counts as a missing value in a delimited file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
