"""Training-data pipeline operators.

Nothing outside this subpackage imports it; the library works without it.
"""
