"""Operators over envelopes, update logs and hop logs."""
