"""Spark-native analysis of data-conversion runs, their logs and the files they work on."""

from runledger.registry import Converter, Flag, Registry, default_registry

__all__ = ["Converter", "Flag", "Registry", "default_registry"]
