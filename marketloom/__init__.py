"""Basket and association-rule jobs on Spark."""
