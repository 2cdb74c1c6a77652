"""Sequence segmentation and episodic-memory analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
