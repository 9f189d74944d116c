"""Event-driven twin analytics on Spark: subjects, relation sets, routes, snapshot/delta chains."""
