"""A feed of diffs as a stream."""
