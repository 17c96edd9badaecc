"""Table readers, fixture views and sinks."""
