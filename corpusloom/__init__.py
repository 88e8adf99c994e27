"""Corpus analytics on Spark: scans, retrieval, linked-entry graphs, evidence statistics, reconciliation and incremental plans as DataFrame functions."""
