"""Readers and writers: tables, documents, file manifests, coordinate systems, the catalog."""
