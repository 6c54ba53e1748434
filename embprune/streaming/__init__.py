"""The map-only passes on streams."""
