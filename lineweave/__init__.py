"""Lineweave: timed-text analytics expressed as Spark DataFrame jobs."""
