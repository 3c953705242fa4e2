"""Queries over the driver's tables: each applies operators of the library, with the SQL that gives the same rows."""

from chronoweave.queries import curating, matching, relational, remembering, retrieval, scalar, workflow

QUERIES = relational.QUERIES | scalar.QUERIES | retrieval.QUERIES | workflow.QUERIES | curating.QUERIES | remembering.QUERIES | matching.QUERIES
ORACLES = relational.ORACLES | scalar.ORACLES | retrieval.ORACLES | workflow.ORACLES | curating.ORACLES | remembering.ORACLES | matching.ORACLES
