"""All queries of the library over the driver's tables, and the SQL that gives the same rows."""

from . import alignment, exchange, measures, records

QUERIES = {**alignment.QUERIES, **measures.QUERIES, **exchange.QUERIES, **records.QUERIES}
ORACLE_SQL = {**alignment.ORACLE_SQL, **measures.ORACLE_SQL, **exchange.ORACLE_SQL, **records.ORACLE_SQL}
