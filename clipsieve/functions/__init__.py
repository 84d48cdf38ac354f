"""Part of clipsieve."""
