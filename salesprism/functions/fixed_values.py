"""Word lists, patterns and limits that the cleaning rules are defined by."""

# Category keywords, first hit wins.
CATEGORY_KEYWORDS = (
    ("smartphone|mobile|phone", "Smartphones"),
    ("laptop|notebook|ultrabook", "Laptops"),
    ("tablet|ipad", "Tablets"),
    ("watch|wearable", "Smart Watches"),
    ("tv|television|entertain", "TV & Entertainment"),
    ("audio|headphone|earbud|earphone|speaker|soundbar", "Audio"),
)

# City spellings.
CITY_FIXES = {
    "Bangalore": "Bengaluru",
    "Banglore": "Bengaluru",
    "Bengalore": "Bengaluru",
    "Calcutta": "Kolkata",
    "Madras": "Chennai",
    "Delhi Ncr": "Delhi",
    "Chenai": "Chennai",
}

# Payment patterns on upper-case text, first hit wins.
PAYMENT_PATTERNS = (
    ("UPI|GOOGLE ?PAY|G?PAY|PHONE ?PE|BHIM", "UPI"),
    ("CREDIT|CC", "Credit Card"),
    ("DEBIT|DC", "Debit Card"),
    ("COD|C\\.?O\\.?D", "COD"),
    ("NET ?BANK", "Net Banking"),
    ("WALLET|PAYTM|AMAZON ?PAY", "Wallet"),
    ("BNPL|PAY ?LATER|LAZY ?PAY|SIMPL", "BNPL"),
)

# The corrected payment rules: wallets and pay-later are looked for before the bare word PAY.
STRICT_PAYMENT_PATTERNS = (
    ("BNPL|PAY ?LATER|LAZY ?PAY|SIMPL", "BNPL"),
    ("WALLET|PAYTM|AMAZON ?PAY", "Wallet"),
    ("UPI|\\bG(OOGLE)? ?PAY\\b|PHONE ?PE|BHIM", "UPI"),
    ("CREDIT|\\bCC\\b", "Credit Card"),
    ("DEBIT|\\bDC\\b", "Debit Card"),
    ("C\\.?O\\.?D|CASH ON DELIVERY", "COD"),
    ("NET ?BANK", "Net Banking"),
)

# Signs cut out of a price.
CURRENCY_SIGNS = "₹$,"

# What is cut out of a rating.
RATING_NOISE = r"stars|star|/5\.0|/5|out of 5"

# Words for yes and no.
YES_WORDS = ("true", "yes", "y", "1")
FLAG_ONE_WORDS = ("true", "yes", "1", "y", "t")
FLAG_ZERO_WORDS = ("false", "no", "0", "n", "f")

# Delivery words for day 0, and the longest single-number delivery.
SAME_DAY_WORDS = ("same day", "same-day", "today")
MAX_DELIVERY_DAYS = 30

# Order value segments, upper bound included.
VALUE_SEGMENTS = ((5000, "Low"), (20000, "Mid"), (50000, "High"), (100000, "Premium"))

# Festival words looked for in event names.
FESTIVAL_WORDS = ("Diwali", "Holi", "Eid", "Christmas", "New Year", "Navratri")

# What counts as a return, by report.
RETURN_WORDS = {
    "returns": ("returned", "refund", "refunded", "return_initiated", "return-approved", "return", "replaced"),
    "export": ("returned", "refund", "refunded"),
    "profit": ("returned",),
}

# Discount slab edges in percent, right-closed.
DISCOUNT_EDGES = (0, 10, 20, 30, 40, 50, 100)

# Date layouts by shape of the date part (slashes and dots read as dashes), day first, then month first.
ISO_DATE = "^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?([ T].*)?$"
YEARS_OF_1900S, YEARS_OF_2000S = "69|[7-9][0-9]", "[0-5][0-9]|6[0-8]"
DATE_SHAPES = (
    ("^[0-9]{1,2}-(1[3-9]|[2-9][0-9])-[0-9]{4}$", ("M-d-yyyy",)),  # the second number is no month
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", ("d-M-yyyy", "M-d-yyyy")),
    ("^[0-9]{8}$", ("yyyyMMdd",)),
    ("^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", ("d-MMM-yyyy",)),
)
# Month names.
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Cost share of the sales amount.
COST_SHARE = 0.70

# Churn weights and days per month.
RISK_WEIGHTS = {"recency": 0.50, "frequency": 0.25, "monetary": 0.25}
DAYS_PER_MONTH = 30.4375
