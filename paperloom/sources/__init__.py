"""Readers of word-processing packages, and the sink that writes them back."""
