"""Part of the labelling library."""
