"""What the loaders raise where malformed input aborts."""


class LoadError(ValueError):
    """A file can't be loaded."""


class FormatError(LoadError):
    """A line doesn't have the expected shape."""


class ParseError(LoadError):
    """A value of a line doesn't parse."""
