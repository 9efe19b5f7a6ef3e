"""Training-data operators: the ten corpus operators and the pieces they share.

Nothing outside this subpackage imports it. Every operator takes DataFrames
and returns a DataFrame; ``queries.py`` wraps them as whole-table queries.
"""
