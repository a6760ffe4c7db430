"""Operators over a :class:`~tillroll.sources.schema.RetailTables` bundle.

``reports`` (R1-R25, reads), ``writes`` (W1-W9, pure batch writes) and
``quality`` (C1-C9, integrity rules returning violations).
"""
