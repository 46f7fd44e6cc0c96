"""Readers, fixed dimensions and synthetic signals."""
