"""Every query of the engine by name, and the SQL that must give the same rows."""

from signalpanel.plans import fleet_queries, study_queries

QUERIES = study_queries.QUERIES | fleet_queries.QUERIES
SQL = study_queries.SQL | fleet_queries.SQL
