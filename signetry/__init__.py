"""Signed-network analytics on Spark: ingest, topology, polarization, interventions, learning, data cleaning."""

__version__ = "0.1.0"
