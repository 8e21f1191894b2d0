"""Training-data operators: search, mixing, PII, dedup, secrets, BPE, quality, HTML."""
