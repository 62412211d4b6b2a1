"""A Spark-native engine for web corpora and training data."""

__version__ = "0.1.0"
__all__ = ["Config", "Engine", "load_config", "__version__"]


def __getattr__(name: str):
    """The public names, loaded on first use: workers that import a module of the package need not load the engine."""
    if name == "Engine":
        from .plans.pipeline import Engine

        return Engine
    if name in ("Config", "load_config"):
        from .plans import config

        return getattr(config, name)
    raise AttributeError(name)
