"""tillsight — basket analytics and fraud screening on Spark.

Every public function takes and returns Spark DataFrames (or Columns); the
heavy lifting is left to Catalyst / AQE.  Sub-packages:

* ``sources``   — readers, the basket view over the driver tables, sinks,
                  nested request/response JSON.
* ``functions`` — Column-level helpers (null semantics, calendar, recoding).
* ``operators`` — features, audits, statistics, rules, encoding, evaluation,
                  Spark ML models.
* ``plans``     — the registered queries (Spark side + SQL twin).
* ``streaming`` — Structured Streaming screening jobs.
"""

__version__ = "0.1.0"
