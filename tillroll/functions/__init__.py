"""Column-expression helpers: exact money (``money``), zone-free timestamps
(``times``) and skew-safe numbering / running sums (``sequence``)."""
