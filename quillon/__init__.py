"""Approximate analytics on Spark: mergeable sketches as DataFrame operators."""
