"""All queries of the core, and their SQL."""

from tallyforge.queries import problems, problems_sql, reference, scalars, storing  # noqa: F401  the last two add to reference's

QUERIES = {**problems.QUERIES, **reference.QUERIES}
SQL = {**problems_sql.SQL, **reference.SQL}
