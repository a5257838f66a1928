"""Data-contract validation and conformance analytics on Spark."""
