"""Crowd-vote calibration, spatial scoring and routing as PySpark DataFrame operators."""
