"""Change capture, compaction and poll statistics, in batch and as streams."""
