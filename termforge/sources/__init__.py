"""Tables on disk: what the index reads and writes."""
