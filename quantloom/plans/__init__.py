"""Query catalogue: name -> (Spark query, oracle SQL or None)."""
