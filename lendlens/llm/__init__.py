"""Training-data operators: thirteen independent modules, their queries and the SQL they agree with.

Nothing else in the library imports this subpackage.
"""
