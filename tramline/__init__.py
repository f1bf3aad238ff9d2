"""Tramline: ride telemetry and roadside evidence analytics as PySpark DataFrame jobs."""
