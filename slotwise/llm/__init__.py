"""Training-data operators: quality, deduplication, extraction, decontamination, packing."""
