"""Readers and writers of clips, sidecars, baselines and condition results."""
