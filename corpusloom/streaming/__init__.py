"""Stateful operators over event streams, with batch forms of equal results."""
