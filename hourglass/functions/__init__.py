from .columns import (trunc_ntz, weekday_mon0, is_weekend, finite_or_null_col,
                      md5_bucket, round6, numeric_columns, string_columns,
                      is_numeric_type)

__all__ = ["trunc_ntz", "weekday_mon0", "is_weekend", "finite_or_null_col", "md5_bucket",
           "round6", "numeric_columns", "string_columns", "is_numeric_type"]
