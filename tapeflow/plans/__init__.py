"""Row numbering, halo slices, running values and plan composition."""
