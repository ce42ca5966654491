"""Training-data operators: deduplication, tokenisation, search, extraction, archives, mixing."""
