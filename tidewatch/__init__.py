"""Tidewatch: platform-activity analytics written as Spark DataFrame jobs."""
