"""A PySpark-native analytics engine: catalog, exchange API, query library, extension points."""

from ferrule.session import Hooks, start_session

__all__ = ["Hooks", "start_session"]
