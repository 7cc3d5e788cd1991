"""deskloom: support-conversation analytics as Spark DataFrame operators."""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
