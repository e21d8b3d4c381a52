"""Views, query registry and SQL."""
