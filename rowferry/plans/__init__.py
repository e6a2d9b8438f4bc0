"""Jobs: mapping jobs with error policies, and works with lookups and merging."""
