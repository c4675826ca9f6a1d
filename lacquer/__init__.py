"""Segmentation, evidence and catalog operators for sampled recordings, as Spark DataFrame functions."""
