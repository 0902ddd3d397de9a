"""Domain operators; each is DataFrame in, DataFrame out."""
