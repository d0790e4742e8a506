"""Column-level helpers shared by the operators."""

from tallyforge.functions.columns import (  # noqa: F401
    best_name,
    categorical_columns,
    datetime_columns,
    days_between,
    dtype_family,
    nan_to_null,
    numeric_columns,
    scalar_row,
    string_columns,
)
from tallyforge.functions.hashing import hash_bucket, hash_unit  # noqa: F401
