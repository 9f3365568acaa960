"""Spatial road-network analytics on Spark: ingestion, graphs, routing, publication and data quality."""
