"""Training-data operators: ten corpus operators for PySpark and their queries.

Nothing else in the library imports this subpackage; ``catalog`` lists its queries and SQL.
"""
