"""Directional passage counting over tracked movement, as Spark jobs on whole archives."""

__version__ = "0.1.0"
