"""Spark jobs for machine-health sound data: features, splits, scores, alerts, evidence and reports."""
