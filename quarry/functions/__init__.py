"""Functions of the dialect as builders of Spark SQL expressions."""

from quarry.functions import dates, math, strings  # noqa: F401
from quarry.functions.base import TABLE, build  # noqa: F401
