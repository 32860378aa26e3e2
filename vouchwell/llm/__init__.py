"""Training-data operators: ten independent corpus operators and their queries.

Nothing outside this subpackage imports it.
"""
