"""The delivery loop."""
