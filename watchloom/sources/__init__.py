"""Readers, writers, dimension generators and the table store."""
