"""Operators of matching studies: distances, kernels, estimators, chains, diagnostics, summaries."""
