"""Catalogs and settings."""
