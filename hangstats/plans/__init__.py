"""The four analyses; each takes ``reports`` and returns DataFrames."""
