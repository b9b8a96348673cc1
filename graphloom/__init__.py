"""graphloom: memory-graph analytics as Spark DataFrame operators."""
