"""Word lists, patterns, weights and limits that results depend on."""

# Column-name pattern -> weight, for the entity key of an event table.
ENTITY_NAME_WEIGHTS = (
    (r"\bcustomer[_\s]?id\b", 3.0),
    (r"\buser[_\s]?id\b", 3.0),
    (r"\bclient[_\s]?id\b", 3.0),
    (r"\baccount[_\s]?id\b", 3.0),
    (r"\bmember[_\s]?id\b", 3.0),
    (r"\bperson[_\s]?id\b", 2.5),
    (r"\bsubject[_\s]?id\b", 2.5),
    (r"\bentity[_\s]?id\b", 2.5),
    (r"\bpatient[_\s]?id\b", 2.5),
    (r"\bemployee[_\s]?id\b", 2.5),
    (r"\bcustomer\b", 2.0),
    (r"\buser\b", 2.0),
    (r"\bclient\b", 2.0),
    (r"\baccount\b", 2.0),
    (r"\bmember\b", 2.0),
    (r"_id$", 1.5),
    (r"^id_", 1.5),
    (r"\bid\b", 1.0),
    (r"[_\-\s]?no$", 0.8),
    (r"[_\-\s]?num$", 0.8),
    (r"[_\-\s]?number$", 0.8),
    (r"[_\-\s]?code$", 0.8),
    (r"[_\-\s]?key$", 0.8),
    (r"[_\-\s]?ref$", 0.6),
)
# Column-name pattern -> deduction, for keys of single transactions.
ENTITY_NAME_DEDUCTIONS = (
    (r"\bproduct\b", 1.5),
    (r"\border\b", 1.5),
    (r"\btransaction\b", 1.5),
    (r"\binvoice\b", 1.5),
    (r"\bsession\b", 1.2),
    (r"\bevent\b", 1.2),
    (r"\bitem\b", 1.0),
    (r"\bsku\b", 1.0),
    (r"\bticket\b", 1.0),
)
# Names that are never an entity key.
ENTITY_SKIPPED_NAMES = ("index", "row", "rownum", "row_num", "row_id", "unnamed", "unnamed: 0")
ENTITY_RATIO_RANGE = (0.005, 0.98)
ENTITY_MIN_ROWS = 1.5
CATEGORY_LIMIT = 50
DATETIME_PARSE_SHARE = 0.8

# Names that make a column an identifier in profiling.
ID_NAME = (
    r"(^|[_\s\-])id([_\s\-]|$)|_id$|^id_|"
    r"^(cust|customer|user|row|record|account|employee|emp|member|order|trans|transaction|"
    r"invoice|ticket|case|item|prod|product|sku)[\s_\-]?id"
)
# The narrower pattern used when scoring target columns.
ID_NAME_SHORT = r"(^|[_\s\-])id([_\s\-]|$)|_id$|^id_"
# Names of key columns shown first in ranked output.
ID_NAME_RANKING = r"(^|[_\s\-])id([_\s\-]|$)|_id$|^id_|customer|account|member|user|client"

TARGET_TOKENS = (
    "target", "label", "class", "outcome", "churn", "converted", "conversion",
    "purchase", "upsell", "y",
)
CHURN_NAMES = (
    "churn", "churned", "attrition", "retention", "cancelled", "canceled",
    "subscription_status", "customer_status", "status", "active", "inactive",
    "left", "exited", "exit", "defected", "defection", "stayed", "loyal",
)
CHURN_NAME_PARTS = ("churn", "attrition", "exit", "cancel", "active")
CHURN_VALUE_PAIRS = (
    ("0", "1"), ("yes", "no"), ("true", "false"), ("active", "inactive"),
    ("active", "cancelled"), ("churned", "not churned"), ("1.0", "0.0"),
)
POSITIVE_WORDS = (
    "yes", "1", "1.0", "true", "churned", "cancelled", "canceled",
    "inactive", "left", "exited", "exit", "defected",
)
NEGATIVE_WORDS = (
    "no", "0", "0.0", "false", "retained", "active", "staying",
    "loyal", "not churned", "stayed", "paused", "pending",
)
POSITIVE_HINT_WORDS = ("1", "yes", "true", "churn", "positive")
TIME_TOKENS = (
    "timestamp", "datetime", "event_time", "event_date", "date", "time", "created", "occurred",
)
SEPARATORS = (",", ";", "\t", " ")
