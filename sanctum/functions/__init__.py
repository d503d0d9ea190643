"""Column functions: spans, masks, predicates, checksums."""
