"""Corvane: change-history analytics and training-data operators on PySpark DataFrames."""

_EXPORTS = {"Graph": "api", "scan": "api", "Config": "config", "load": "config", "build": "pipeline", "GraphStore": "sources.store", "AgentSession": "agent", "local_session": "session"}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    # The parts are loaded when they are asked for, so a worker that needs one function loads little.
    if name in _EXPORTS:
        from importlib import import_module

        return getattr(import_module(f".{_EXPORTS[name]}", __name__), name)
    raise AttributeError(name)
