"""Verified data quality on Spark: detect, grade, repair and verify tables."""

from .api import CleanSummary, Report, attach, clean, diagnose, profile_df, read, read_sql, write

__all__ = ["CleanSummary", "Report", "attach", "clean", "diagnose", "profile_df", "read", "read_sql", "write"]
__version__ = "0.1.0"
attach()
