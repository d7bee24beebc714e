"""A PySpark-native engine for episodic vector memory."""

__version__ = "0.1.0"
__all__ = ["Maintenance", "Memory", "MemoryConfig", "Options", "SyntheticWorld", "WorldModel"]

_HOMES = {"MemoryConfig": "config", "Maintenance": "memory", "Memory": "memory", "Options": "memory", "SyntheticWorld": "sources.synthetic", "WorldModel": "sources.synthetic"}


def __getattr__(name: str):
    """Load the front door on first use, so that workers that unpickle a function import no more than they need."""
    if name not in _HOMES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
