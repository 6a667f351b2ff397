"""Training-data operators: deduplication, language, toxicity, packing, media, token files, mixing, search."""
