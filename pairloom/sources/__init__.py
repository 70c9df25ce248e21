"""Reading and writing study data: replications, result files, numbered outputs."""

from pairloom.sources.datasets import archives, draw_outcomes, generate, get_or_create, read_archives, read_npz, read_units, write_units
from pairloom.sources.results import next_names, next_number, read_results, run_folder, write_results

__all__ = [
    "archives", "draw_outcomes", "generate", "get_or_create", "next_names", "next_number", "read_archives", "read_npz", "read_results", "read_units", "run_folder",
    "write_results", "write_units",
]
