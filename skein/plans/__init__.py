"""Planning helpers: lineage cuts and iteration."""
