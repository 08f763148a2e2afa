"""Every rejection has a type of its own; nothing is cut short silently."""

from __future__ import annotations


class MillraceError(Exception):
    """Base of all errors that this library raises itself."""

    #: Whether the same request can succeed later.
    retryable = False


class InvalidTopology(MillraceError):
    """The document is no valid job graph; nothing was stored."""


class LimitExceeded(InvalidTopology):
    """A bound of Limits would be crossed."""


class OperatorFailure(MillraceError):
    """A row made an operator fail: the job ends failed, with code 1."""


class RequestError(MillraceError):
    """A client's request is refused."""


class IdentityReuse(RequestError):
    """The client's last sequence number came again with another request."""


class StaleRequest(RequestError):
    """The sequence number is below the client's last one."""


class SkippedRequest(RequestError):
    """The sequence number is not the next one."""


class CapacityExhausted(RequestError):
    """Too many jobs are active or retained."""

    retryable = True


class NotFound(RequestError):
    """No such job."""


class InvalidTransition(RequestError):
    """The job's state or revision does not allow this."""


class ResultUnavailable(MillraceError):
    """The job has no complete manifest."""

    retryable = True


class ManifestMismatch(MillraceError):
    """The results are not those that the digest names."""


class CorruptResult(MillraceError):
    """One identity is there twice, or the rows are not those that the manifest counts."""


class PageTooSmall(MillraceError):
    """The next record alone is larger than the page's budget; required has its bytes."""

    def __init__(self, required: int):
        super().__init__(f"the next record needs a page of {required} bytes")
        self.required = required


class MissingField(MillraceError):
    """A result record has no field of that name."""
