"""slipstone: duplicate detection, document quality and reporting for payment vouchers on Spark."""

from .config import ScoringConfig
from .session import get_spark

__all__ = ["ScoringConfig", "get_spark"]
