"""Operators for preparing training data, their queries and SQL twins.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is there.
"""
