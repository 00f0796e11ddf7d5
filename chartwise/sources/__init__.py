"""Table scans, analog views and file sources / sinks."""
