"""Column-expression helpers (all JVM-side, codegen friendly)."""

from .classify import care_level, recode_cause
from .numeric import (clip_lower, exact_mean_2dp, pooled_rate, round_half_even, safe_div,
                      stable)
from .text import blank_to_null, contains_ci, head_before, is_blank, map_labels, replace_all, utrim

__all__ = [
    "care_level", "recode_cause", "clip_lower", "exact_mean_2dp", "pooled_rate",
    "round_half_even", "safe_div", "stable", "blank_to_null", "contains_ci", "head_before",
    "is_blank", "map_labels", "replace_all", "utrim",
]
