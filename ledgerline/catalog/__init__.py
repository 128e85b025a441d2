"""The query catalog, one module per area."""

from importlib import import_module

AREAS = ("facts", "metrics", "periods", "ratios", "companies", "revenue", "markets", "texts", "sources")


def load() -> None:
    """Import every area so that its queries are registered."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
