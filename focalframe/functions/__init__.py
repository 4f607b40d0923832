"""Column functions for use in own queries."""

from ..operators.analysis import luma, quantise, srgb_encode
from ..operators.catalog import capture_time, error_code, export_name, trailing_number
from ..operators.geometry import compose, invert, rescale, similarity, translation

__all__ = ["capture_time", "compose", "error_code", "export_name", "invert", "luma", "quantise", "rescale", "similarity", "srgb_encode", "trailing_number", "translation"]
