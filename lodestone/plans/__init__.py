"""Views, registry and catalogs of queries."""


def catalog() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from lodestone.plans import catalog_files, catalog_rows, catalog_stream, catalog_tags, catalog_text, catalog_vectors, registry  # noqa: F401

    return registry.QUERIES, registry.SQL
