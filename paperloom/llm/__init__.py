"""Operators for large-scale training-data preparation.  Nothing else in paperloom imports this subpackage."""
