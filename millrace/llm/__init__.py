"""Operators for preparing training data at scale. Nothing else in this library imports this subpackage."""
