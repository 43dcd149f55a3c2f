"""Panel analytics on Spark: composable DataFrame -> DataFrame operators for tables keyed by symbol and time."""
