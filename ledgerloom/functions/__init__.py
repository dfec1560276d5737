"""Scalar helpers: small Column expressions shared by the jobs."""

from .scalar import (  # noqa: F401
    as_date_col,
    exact_sum,
    exact_avg,
    falsy_default,
    hours_ago,
    int_sum,
    markup_price,
    mean_of_three,
    numeric_prefix_float,
    numeric_prefix_int,
    stock_status,
    trailing_days,
    blank_to_null,
)
