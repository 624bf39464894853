"""Training-data operators: deduplication, media, tokens, web records, mixing and quality."""
