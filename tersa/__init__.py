"""tersa: customer-data quality as Spark DataFrame operators."""

from .plans.clean import CleanOptions, CleanResult, clean

__all__ = ["CleanOptions", "CleanResult", "clean"]
__version__ = "0.1.0"
