"""Attack-surface analytics as composable Spark DataFrame functions."""
