"""End-to-end plans: ingest -> clean -> join -> impute, and the query catalog."""
