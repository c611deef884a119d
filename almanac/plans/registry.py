"""All queries of the planning engine, and the SQL that each must agree with."""

from __future__ import annotations

from almanac.plans import advice, bulletins, outlines, papers, relational, requests, textual

QUERIES = {**relational.QUERIES, **textual.QUERIES, **advice.QUERIES, **outlines.QUERIES, **bulletins.QUERIES, **requests.QUERIES, **papers.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **textual.ORACLE_SQL, **advice.ORACLE_SQL, **outlines.ORACLE_SQL, **bulletins.ORACLE_SQL, **requests.ORACLE_SQL, **papers.ORACLE_SQL}
