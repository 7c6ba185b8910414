"""Literals that must equal the original report's for the
results to match. Stated once, here, in the order the report uses them."""

# Subscription statuses the report tests for, and the churn pattern
# (case-sensitive LIKE).
ACTIVE = "Active"
CANCELLED = "Cancelled"
ACTIVE_LIKE = "%Active%"

# Churn labels.
NOT_CHURNED = "Not Churned"
CHURNED = "Churned"

# Event types.
LOGIN = "login"
LOGOUT = "logout"
PAGE_VIEW = "page_view"
FEATURE_USE = "feature_use"
# Navigation, excluded from product use.
NAVIGATION_EVENTS = [LOGIN, LOGOUT, PAGE_VIEW]

# JSON path of the page name in the event metadata (`metadata->>'page'`).
PAGE_PATH = "$.page"

# Annualisation factor of MRR.
MONTHS_PER_YEAR = 12
