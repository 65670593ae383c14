"""Panel analytics on Spark: declarative DataFrame operators for retail panels."""
