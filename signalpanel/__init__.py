"""Evidence engine for asset-day panels on Spark."""
