"""Part of paperloom."""
