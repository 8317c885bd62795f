"""gleaner: web-grounding data jobs as Spark DataFrame and Structured Streaming plans.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns);
nothing is collected to the driver except bounded configuration tables (the allowlist).
"""

__version__ = "0.1.0"
