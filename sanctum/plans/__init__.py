"""Plans built from the operators: scan, sanitise, apply a map, batches."""
