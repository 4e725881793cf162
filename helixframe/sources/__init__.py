"""Readers and writers: configuration, sequence files, mutations, and the stored container."""
