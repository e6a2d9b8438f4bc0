"""Frame-to-frame operators: numbering, lookups, conversion with rejects, merging."""
