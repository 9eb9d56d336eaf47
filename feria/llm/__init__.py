"""Training-data operators: dedup, token files, quality, licences, fingerprints, mixing, URL filters."""
