"""Fixed values.

These must equal the values the business data and downstream readers use, so they
are stated here once, plainly.
"""

# --- FIXED VALUES: document types of order_transactions -------------------------------
SALE = "銷貨"       # sale
RETURN = "銷退"     # sales return (negative quantity)
RESTOCK = "補貨"    # restock
ALL_CATEGORIES = "全部類別"  # "all categories": the filter value that means no filter

# --- FIXED VALUES: volatility groups of the monthly forecast -----------------------------
VOL_LOW = "低波動"
VOL_MEDIUM = "中波動"
VOL_HIGH = "高波動"
CV_LOW_MAX = 0.4
CV_MEDIUM_MAX = 0.8
CV_SENTINEL = 999.0      # CV when the mean is not positive
APE_SENTINEL = 999.0     # APE when actual is 0 and forecast > 0

# Forecast method per volatility group.
METHOD_BY_GROUP = {VOL_LOW: "trend", VOL_MEDIUM: "ewma", VOL_HIGH: "median"}

# --- FIXED VALUES: forecast windows (months) --------------------------------------------
HISTORY_MONTHS = 18
RECENT_SHARE_MONTHS = 5
EWMA_ALPHA = 0.3

# --- FIXED VALUES: customer segments (M7) and order-rate thresholds (M10) ---------------
SEGMENT_VIP = "核心VIP客戶"        # core VIP
SEGMENT_IMPORTANT = "重要客戶"     # important
SEGMENT_ACTIVE = "活躍客戶"        # active
SEGMENT_PLANNED = "計劃型客戶"     # planned buyer
SEGMENT_NEW = "新客戶"             # new
ORDER_RATE_THRESHOLD_HIGH_VALUE = 0.15   # VIP and important customers
ORDER_RATE_THRESHOLD_NEW = 0.4           # new customers
ORDER_RATE_THRESHOLD_DEFAULT = 0.25      # everyone else

# --- FIXED VALUES: incoming-order status codes -------------------------------------------
STATUS_OPEN = "0"
STATUS_CONFIRMED = "1"
STATUS_DELETED = "2"

# --- FIXED VALUES: delivery row statuses written by the triggers (S5) -------------------
DELIVERY_FROM_ORDER = "order"
DELIVERY_FROM_PREDICTION = "prediction"

# --- FIXED VALUES: prospect classes (C9/C10), highest priority first ---------------------
PROSPECT_PURCHASED = "purchased"
PROSPECT_CAN_PROCESS = "can_process"
PROSPECT_NO_ID = "cannot_process"
PROSPECT_POTENTIAL = "potential"

# --- FIXED VALUES: keyword table of the test adapter -------------------------------------
TEST_KEYWORDS = ("the", "and", "und", "ing", "aux")

# --- FIXED VALUES: default as-of dates of the test adapter -------------------------------
AS_OF_MONTHLY = "2001-08-01"
AS_OF_REPLEN = "2024-01-30"
SAMPLE_DATE_LONG = "2001-07-01"
