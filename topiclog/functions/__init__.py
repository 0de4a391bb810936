"""Scalar rules of the log as column expressions."""
