"""Bias-corrected monitoring of event populations, expressed as Spark plans."""
