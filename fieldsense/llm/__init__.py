"""Operators for preparing training text: cleaning, near-duplicate search,
scoring, sharding, mixing and tokenising. Nothing else in the library imports
this subpackage."""
