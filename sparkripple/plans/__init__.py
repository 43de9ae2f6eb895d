"""Decision plans over many diffs at once, and the corpus views that test them."""
