"""Catalogue cleaning, linking, profiling and tagging as lazy Spark plans."""
