"""Registered query plans over the supplied tables and their SQL twins."""

from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
