"""Biodiversity and geospatial analytics as PySpark DataFrame operators."""
