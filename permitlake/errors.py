"""Refusals. Whoever catches one must return nothing, never everything."""


class PermissionRefused(Exception):
    """Base of every refusal."""


class PurposeRequired(PermissionRefused):
    """A query named no purpose; there is no default."""


class UnknownPurpose(PermissionRefused):
    """A purpose outside the closed vocabulary."""


class LedgerUnavailable(PermissionRefused):
    """The ledger could not answer."""
