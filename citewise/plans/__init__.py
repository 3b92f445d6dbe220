"""Plan shapes shared by the operators: two-level scans, checked small joins, whole-question plans."""
