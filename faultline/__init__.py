"""Defect analytics on commit, file-change, source and snapshot tables, on Spark."""
