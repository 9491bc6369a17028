"""Schemas: parsing, compilation to columns, evaluation, types and documents."""
