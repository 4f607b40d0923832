"""Reference operators."""
