"""Operators for training data, each over whole tables."""
