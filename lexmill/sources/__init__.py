"""Stored collections: mutation log, checkpoints, backups."""
