from gristmill.queries.registry import REGISTRY, Tables, query
from gristmill.queries import (  # noqa: E402,F401
    cleaning, combining, linking, profiling, searching, tagging,
)

__all__ = ["REGISTRY", "Tables", "query"]
