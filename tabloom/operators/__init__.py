"""Table-to-table operators: profile, clean, impute, encode, train, score, blend."""
