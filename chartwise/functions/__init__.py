"""Column builders: hashing, clipping, rounding, list parsing, binning, closed-form statistics."""
