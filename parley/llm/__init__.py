"""Training-data operators: deduplication, decontamination, mixing, scans and search."""
