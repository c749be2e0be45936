"""Encyclopedia-dump, link-graph and page-similarity analytics as Spark jobs.

Every public function takes and returns DataFrames (or Columns) and is lazy,
except where its docstring says that it cuts lineage or runs a stream.
"""
