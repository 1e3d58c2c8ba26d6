"""Every operator bound to the given tables, with its SQL where there is one."""

from riskloom.catalog import files, modelling, scalars, tables

QUERIES, ORACLES = {}, {}
for part in (scalars, tables, files, modelling):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
