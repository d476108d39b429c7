"""Governed analytics on Spark: policies, lineage, masking, audit analytics, and corpus operators."""
