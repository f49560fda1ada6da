"""Training-data operators: formatting, near-duplicates, search, filters, mixing, packing."""
