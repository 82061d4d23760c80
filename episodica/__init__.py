"""Cohort studies on Spark: DataFrame operators for longitudinal patient data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from episodica.config import StudyConfig

# Functions that run in tasks travel with the job: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["StudyConfig"]
