"""Readers of the tables, project manifests and seeds that the engine works on."""
