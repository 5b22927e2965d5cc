"""Exceptions of the engine."""


class QuernError(Exception):
    """Base class."""


class DuplicateIdError(QuernError):
    """A document's _id exists already."""


class NoMatchError(QuernError):
    """No document matches an update or a replacement."""


class ReadOnlyError(QuernError):
    """A write to a collection opened for reading."""


class InvalidIdError(QuernError, TypeError):
    """An _id that isn't a string, or an attempt to change one."""


class InvalidFilterError(QuernError, ValueError):
    """A filter that no operator explains."""


class InvalidDocumentError(QuernError, ValueError):
    """A document that doesn't fit a column's type."""


class ConflictError(QuernError):
    """Another writer committed in between."""
