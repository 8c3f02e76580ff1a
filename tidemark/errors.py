"""Errors by category."""


class TidemarkError(Exception):
    """Base of all errors that this package raises."""


class InvalidFilterError(TidemarkError):
    pass


class InvalidOrderClauseError(TidemarkError):
    pass


class InvalidSelectClauseError(TidemarkError):
    pass


class InvalidLimitError(TidemarkError):
    pass


class InvalidAfterClauseError(TidemarkError):
    pass


class InvalidIncludeError(TidemarkError):
    pass


class CollectionNotFoundError(TidemarkError):
    pass


class RelationNotFoundError(TidemarkError):
    pass


class SchemaError(TidemarkError):
    pass


class ValidationError(TidemarkError):
    pass


class WritePermissionError(TidemarkError):
    pass


class EntityNotFoundError(TidemarkError):
    pass
