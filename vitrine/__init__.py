"""Collectible-asset analytics as Spark DataFrame operators."""
