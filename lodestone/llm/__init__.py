"""Training-data operators: quality, toxicity, duplicates, secrets, search, tokens, mixing."""
