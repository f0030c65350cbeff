"""Training-data operators: secrets, PII, language, near duplicates, mixing, media, WARC, tokens."""
