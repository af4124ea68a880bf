"""Flow table in, result table out: every operator is a lazy DataFrame transformation."""
