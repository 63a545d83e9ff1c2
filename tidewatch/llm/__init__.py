"""Training-data operators: dedup, token counts, decontamination, mixing, sharding, language ID, WARC and quality rules."""
