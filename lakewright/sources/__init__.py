"""Readers with explicit schemas and strict or skipping rules."""
