"""Spark jobs over detections on laser-scanned sites."""
