"""Column functions that the operators share."""

from pairloom.functions.numbers import finite, float_label, missing_to_null, ratio, rounded
from pairloom.functions.texts import items, numbers, size_map
from pairloom.functions.uniform import normal, uniform, uniform_of, uniforms

__all__ = ["finite", "float_label", "items", "missing_to_null", "normal", "numbers", "ratio", "rounded", "size_map", "uniform", "uniform_of", "uniforms"]
