"""Data-set operators outside the query algebra: column statistics, the disk model, result checks and query suites."""
