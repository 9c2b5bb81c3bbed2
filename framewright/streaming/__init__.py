"""Stateful operators for streams."""
