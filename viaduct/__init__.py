"""Viaduct: road-network resilience and raster analytics as Spark DataFrame jobs."""
