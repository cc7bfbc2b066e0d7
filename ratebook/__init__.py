"""ratebook: fee forms, FX rate tables and rate extraction as Spark DataFrame jobs.

Packages: ``functions`` (column expressions), ``operators`` (DataFrame
operators), ``sources`` / ``sinks`` (readers and writers), ``plans``
(composite jobs and the query catalog), ``streaming`` (landed rate files
merged per micro-batch).
"""

__version__ = "0.1.0"
