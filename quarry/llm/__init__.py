"""Operators of a training-data pipeline, one module per operator, with their queries.

Nothing else in the library imports this subpackage; it imports only general
helpers (session settings, shared-folder tables) from the rest.
"""
