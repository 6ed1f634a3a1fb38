"""Bibliographic tables derived by SQL from the driver's order tables."""
