"""Errors that name what to do about them."""


class HeatgraphError(Exception):
    """Base of all errors of this library."""


class ConfigError(HeatgraphError):
    """A setting that isn't known or can't be."""


class ManifestError(HeatgraphError):
    """The index was built with other settings."""


class SourceError(HeatgraphError):
    """An input that can't be read as what it should be."""


class ProviderError(HeatgraphError):
    """A model that can't be used."""
