"""Verified evidence analytics on Spark: counts, quotes, samples and checks that trace to rows."""
