"""Interference detection between triangle meshes as Spark plans."""
