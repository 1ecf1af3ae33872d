"""Micro-batched mutations and reads of pinned versions."""
