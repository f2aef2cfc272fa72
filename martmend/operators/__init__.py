"""Key routing, targeted recomputation, comparison, repair, checks and lineage."""
