"""Event-table analytics on Spark: intervals, matching, curation, vectors and chunked signals."""
