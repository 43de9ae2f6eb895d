"""Scans of git diffs and source trees, and the metadata snapshot."""
