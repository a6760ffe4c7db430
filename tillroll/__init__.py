"""tillroll — online-retail analytics as Spark DataFrame jobs.

Eight relational tables (country, customer, category, product, the
product_category bridge, invoice, invoice_line, payment) travel together as a
:class:`~tillroll.sources.schema.RetailTables` bundle.  Every operator is a
pure function from that bundle (plus explicit parameters) to DataFrames:

* ``tillroll.operators.reports`` — sales reports and lookups (read only)
* ``tillroll.operators.writes``  — batch write operators returning the new
  table snapshot together with the affected / rejected rows
* ``tillroll.operators.quality`` — integrity rules returning violations
* ``tillroll.sources``           — schemas, loaders, the star-schema mapping,
  the seed fixture and snapshot publishing
* ``tillroll.functions``         — exact decimal money helpers
* ``tillroll.plans``             — session settings and the query catalog
"""

from tillroll.sources.schema import RetailTables

__all__ = ["RetailTables"]
