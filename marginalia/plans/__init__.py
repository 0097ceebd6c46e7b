"""The registered queries and the SQL each of them is checked against."""

from marginalia.plans import changing, flowing, reading, storing

QUERIES = {**reading.QUERIES, **changing.QUERIES, **flowing.QUERIES, **storing.QUERIES}
ORACLES = {**reading.ORACLES, **changing.ORACLES, **flowing.ORACLES, **storing.ORACLES}
