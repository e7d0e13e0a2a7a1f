"""SQL twins of the core queries."""

from cellweave import annotation_sql, problems_sql

SQL: dict[str, str] = {**annotation_sql.SQL, **problems_sql.SQL}
