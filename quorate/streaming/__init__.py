"""Incremental work: what is still to be done, and appends that can be repeated."""
