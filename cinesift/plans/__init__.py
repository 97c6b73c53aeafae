"""Whole commands, as plans over a folder."""
