"""Transport accessibility as Spark DataFrame jobs: tables in, tables out."""

__all__ = ["functions", "operators", "plans", "sources"]
