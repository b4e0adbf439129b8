"""Registered queries over the given tables and the SQL they are checked against."""


def load():
    """Import every module that registers queries and return the registry."""
    from . import behaviour, catalogue, finding, registry, streams  # noqa: F401
    return registry
