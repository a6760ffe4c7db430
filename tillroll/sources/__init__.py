"""Schemas, loaders and request inputs.

``schema`` (table schemas, the RetailTables bundle), ``starmap`` (driver star
schema -> retail tables), ``requests`` (order / refund / catalog requests),
``tables`` (snapshot load and publication), ``seed`` (test fixture).
"""
