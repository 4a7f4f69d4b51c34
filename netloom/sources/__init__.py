"""Readers, writers and bulk decoders."""
