"""Operators over DataFrames of clips, scenes, frames, captions and files."""
