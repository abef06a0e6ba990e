"""Analytics for fund-level performance data on Spark."""
