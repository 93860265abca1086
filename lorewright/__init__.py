"""Lorewright: knowledge analytics as Spark DataFrame transformations."""
