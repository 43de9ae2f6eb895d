"""Scalar expressions over paths, class names and source text."""
