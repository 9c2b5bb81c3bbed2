"""Views over tables, settings, and the queries with their SQL."""
