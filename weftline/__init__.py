"""weftline: structural-evolution analytics as composable Spark DataFrame operators."""
