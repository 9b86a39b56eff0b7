"""Readers and writers: files, seeds, tables and materialisation."""
