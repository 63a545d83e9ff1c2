"""All registered queries of the network-behaviour operators, with the SQL each is compared with."""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _collect() -> None:
    import importlib
    import pkgutil

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        found = importlib.import_module(f"{__name__}.{module}")
        QUERIES.update(getattr(found, "QUERIES", {}))
        ORACLE_SQL.update(getattr(found, "ORACLE_SQL", {}))


_collect()
