"""Errors that callers tell apart."""


class VicinalError(Exception):
    """The base of all errors raised here."""


class FilterSyntaxError(VicinalError, ValueError):
    """An unknown operator, or a key that is not column__operator."""


class UnsupportedTypeError(VicinalError, TypeError):
    """A filter value of a type that its operator does not take."""


class TemplateError(VicinalError, ValueError):
    """Template data that is incomplete or invalid."""


class QueryError(VicinalError):
    """SQL that does not parse or does not resolve."""


class MetadataError(VicinalError):
    """A metadata lookup without ids, or ids without metadata."""


class OntologyError(VicinalError, ValueError):
    """An ontology that is incomplete, has a cycle, or lacks the column asked for."""


class IndexConfigurationError(VicinalError, ValueError):
    """A vector index whose settings do not hold together, or that is absent."""


class SearchError(VicinalError):
    """Queries without neighbours, or vectors of a wrong dimension."""


class NotFound(VicinalError, LookupError):
    """No row where one is asked for."""


class AccessDenied(VicinalError, PermissionError):
    """A row that the user must not see."""


class QuotaExceeded(VicinalError):
    """More cells asked for than are left."""


class VersionError(VicinalError, ValueError):
    """A client version that is no version."""


class InputError(VicinalError, ValueError):
    """A query matrix without the columns or types it must have."""
