"""Spark operators for lending-fairness analytics on loan application registers."""
