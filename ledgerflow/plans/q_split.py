"""Per-id queries for operators that are computed inside a combined query: each is a
projection of that query, and its oracle SQL is the same projection of the combined SQL."""

from __future__ import annotations

from ledgerflow.plans import q_forecast, q_ingest, q_lifecycle  # noqa: F401  (registers the combined queries)
from ledgerflow.plans.registry import ORACLE, QUERIES, query

SPLITS = {
    "X1": ("X_text", ["customer_id", "phone_or_default"], "X1: blank/'None' → default value."),
    "X9": ("X_text", ["customer_id", "schedule_sorted", "schedule_names"], "X9: weekly schedule sorted and named."),
    "X11": ("X_text", ["customer_id", "safe_name"], "X11: path-safe names."),
    "X14": ("X_text", ["customer_id", "trimmed_name"], "X14: display-name trimming."),
    "X3": ("X_calendar", ["o_orderkey", "month_start", "plus_2_months", "month_end"], "X3: month arithmetic."),
    "X5": ("X_calendar", ["o_orderkey", "elapsed_days"], "X5: whole elapsed days."),
    "X6": ("X_calendar", ["o_orderkey", "day_of_week", "weekday_name", "day_of_month", "month", "quarter",
                          "is_weekend", "is_sunday"], "X6: calendar parts (Monday = 0)."),
    "X7": ("X_product", ["product_id", "price_band"], "X7: bucket labels."),
    "X10": ("X_product", ["product_id", "quantity_text"], "X10: quantity with unit."),
    "X12": ("X_product", ["product_id", "core_name"], "X12: product core name."),
    "X8": ("M5", ["subcategory", "volatility_group", "prediction_method"], "X8: forecast method per volatility group."),
    "X15": ("C7", ["transaction_id", "source_order_id", "id_collision"], "X15: deterministic 8-character ids."),
    "W3": ("A10", ["subcategory", "product_id", "allocation_ratio"], "W3: share of the subcategory total."),
    "W7": ("SRC1", ["file", "row_no", "customer_id", "currency"], "W7: forward-filled sheet cells."),
}


def _register(name: str, base: str, cols: list[str], doc: str) -> None:
    sql = f"SELECT {', '.join(cols)} FROM ({ORACLE[base]}) AS b"

    def fn(spark, sf_dir):
        return QUERIES[base](spark, sf_dir).select(*cols)

    fn.__doc__ = doc
    fn.__name__ = f"split_{name.lower()}"
    query(name, sql)(fn)


for _name, (_base, _cols, _doc) in SPLITS.items():
    _register(_name, _base, _cols, _doc)
