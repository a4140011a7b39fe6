"""Driftmark: nearest-neighbour fraud scoring and corpus preparation as Spark plans."""
