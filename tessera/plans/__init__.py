"""Requests compiled into column expressions and DataFrame steps."""
