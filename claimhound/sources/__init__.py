"""Schemas, loaders and the shared-folder tables the analyses read."""
