"""Velocity tiering and audit of distribution-centre items on PySpark."""
