"""Readers and writers of knowledge bases, labels, tables and result files."""
