"""The registered queries, over views of the given tables."""


def load():
    """Import every query module and return the registry."""
    from . import registry
    from . import (  # noqa: F401
        ensemble,
        features,
        genes,
        markers,
        runs,
        scoring,
        sequences,
        sources,
        training,
    )

    return registry
