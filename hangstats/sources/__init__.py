"""Report files: selection by dimension, sampling, reading."""
