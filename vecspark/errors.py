"""Errors of the public API."""


class NotFoundError(LookupError):
    """No record has the requested id."""

    status_code = 404


class BadRequestError(ValueError):
    """A search request that cannot be turned into a vector."""

    status_code = 400
