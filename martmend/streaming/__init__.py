"""Change data capture: pairing, routing, batch log, micro-batches."""
