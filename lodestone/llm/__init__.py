"""Training-data operators: corpus-scale operators and their registered queries.

Nothing else in the library imports this subpackage; ``queries`` holds the
driver-facing registry.
"""
