"""Training-data operators: URL filters to benchmark decontamination. Nothing else in the library imports this package."""
