"""Plan-level compositions: shared-scan segments, page plans, the daily rollup table."""
