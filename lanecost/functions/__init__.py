"""Functions of the cost-anomaly and evidence engine."""
