"""Top-k high-utility itemsets over uncertain transactions, on Spark."""
