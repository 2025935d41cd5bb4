"""Readers, writers, the synthetic panel and the run ledgers."""
