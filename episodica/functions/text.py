"""Names of covariates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def covariate_name(*parts: Column | str) -> Column:
    """Parts joined by an underscore, blanks turned into underscores, null written NA."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("NA")) for p in parts]
    return F.replace(F.concat_ws("_", *cols), F.lit(" "), F.lit("_"))


def underscored(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("_"))
