"""tessera: a small, strict SQL dialect compiled to lazy Spark DataFrames."""

__all__ = ["Database", "Result"]


def __getattr__(name: str):
    if name in __all__:
        from tessera import database

        return getattr(database, name)
    raise AttributeError(name)
