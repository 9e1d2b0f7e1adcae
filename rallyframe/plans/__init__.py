"""All registered queries of the library with their SQL twins."""

from . import motion, quality, records

QUERIES = {**quality.QUERIES, **motion.QUERIES, **records.QUERIES}
ORACLE = {**quality.ORACLE, **motion.ORACLE, **records.ORACLE}
