"""CI test-failure analytics as Spark DataFrame transformations."""

from testpulse.plans.analyze import Analysis, analyze

__all__ = ["Analysis", "analyze"]
