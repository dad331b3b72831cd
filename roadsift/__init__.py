"""Driving-scenario mining, verification and retrieval as Spark DataFrame operators."""
