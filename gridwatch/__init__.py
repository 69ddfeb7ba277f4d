"""gridwatch — meter tamper-event analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or plain Python
parameters) and is built from Spark's own operators, so Catalyst and AQE
plan the work.  Sub-packages:

* ``sources``   — scans, CSV ingest, fixture projections, merge sinks, exports
* ``functions`` — column-level helpers (coercion, LIKE patterns, tile maths)
* ``operators`` — joins, filters, summaries, dashboards, paging, spatial
* ``plans``     — the resumable refresh pipeline
* ``streaming`` — Structured Streaming forms of the incremental operators
"""

__version__ = "0.1.0"
