"""Customer-drift monitoring as composable PySpark DataFrame operators."""
