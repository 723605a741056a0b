"""Column expressions shared by the operators (all built-in, JVM-side)."""

from .columns import (
    any_differs,
    any_key_null,
    has_value,
    yyyymmdd,
)
from .logformat import (
    LOG_PATTERN,
    METRIC_NAMES,
    format_input_count,
    format_output_count,
    format_verification,
    metric_name,
)

__all__ = [
    "LOG_PATTERN",
    "METRIC_NAMES",
    "any_differs",
    "any_key_null",
    "format_input_count",
    "format_output_count",
    "format_verification",
    "has_value",
    "metric_name",
    "yyyymmdd",
]
