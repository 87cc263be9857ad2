"""All registered queries outside the optional subpackage, and their SQL."""

from quarry.plans import chunks, corpus, indexes, ingest, raw, search, sessions

QUERIES: dict = {**search.QUERIES, **corpus.QUERIES, **sessions.QUERIES, **ingest.QUERIES, **raw.QUERIES, **indexes.QUERIES, **chunks.QUERIES}
ORACLE_SQL: dict = {**search.ORACLE_SQL, **corpus.ORACLE_SQL, **sessions.ORACLE_SQL, **ingest.ORACLE_SQL, **raw.ORACLE_SQL, **indexes.ORACLE_SQL, **chunks.ORACLE_SQL}
