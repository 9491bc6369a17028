"""Batch operators over event, outbox and registry tables."""
