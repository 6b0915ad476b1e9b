"""Call-cost analytics and corpus operators on Spark."""

__version__ = "0.2.0"
