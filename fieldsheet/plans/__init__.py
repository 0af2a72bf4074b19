"""Plan shapes shared by the operators: bounded ranking, skew-safe joins, block scans, intervals."""
