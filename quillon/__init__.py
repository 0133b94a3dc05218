"""Behavioural sequence analytics on Spark: nested records, sequence features, ranking metrics, keyed state."""
