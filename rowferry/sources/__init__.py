"""Where rows come from and where they go: CSV files, tables, queries, JDBC."""
