"""Row classifiers expressed as built-in expressions (no Python worker)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import Config
from .text import map_labels, utrim


def care_level(col: Column | str) -> Column:
    """Care level from a facility-type text by upper-cased substring tests.

    Hospital keywords win over primary-care keywords; NULL falls to "other"
    (the source converts NULL to the text 'NONE' first, which matches nothing).
    """
    c = F.upper(F.col(col) if isinstance(col, str) else col)

    def any_of(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.coalesce(c.contains(w), F.lit(False))
        return cond

    return (F.when(any_of(C.HOSPITAL_KEYWORDS), F.lit(C.LEVEL_HOSPITAL))
            .when(any_of(C.PRIMARY_KEYWORDS), F.lit(C.LEVEL_PRIMARY))
            .otherwise(F.lit(C.LEVEL_OTHER)))


def recode_cause(col: Column | str, cfg: Config) -> Column:
    """Trim, then exact-match recode of cause labels; unmapped labels kept."""
    return map_labels(utrim(col), cfg.cause_labels)
