"""Spark-native operators for dense two-dimensional data, the catalogues that describe it, and training text."""

from importlib import import_module as _load

from . import registry as _registry

for _name in _registry.MODULES:
    _load(f"{__name__}.{_name}")
