"""Training-data operators: deduplication, scans, language ID, decontamination, media and packing."""
