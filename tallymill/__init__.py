"""Settlement reconciliation, allocation and reporting as Spark plans."""
