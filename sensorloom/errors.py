"""Typed refusals. A refusal is a result: it says why an answer can't be given."""

from __future__ import annotations


class Refusal(Exception):
    """Base of all refusals; ``row`` is its form in a refusals table."""

    def row(self, step: str, tags: str) -> tuple[str, str, str, str]:
        return (step, tags, type(self).__name__, str(self))


class SchemaError(Refusal):
    """Missing columns, naive stamps, bad metadata, unexplained strings, duplicates where unique stamps are needed."""


class InsufficientQuality(Refusal):
    """Too few valid rows, a censored baseline, or no duration."""


class IncomparableSampling(Refusal):
    """Calculation bases are mixed."""


class NonMonotonicIndex(Refusal):
    """Timestamps run backwards; ``positions`` says where."""

    def __init__(self, message: str, positions: tuple[int, ...] = ()):
        super().__init__(message)
        self.positions = positions


class UnresolvedUnit(Refusal):
    """A unit is not in the table."""


class IncomparableUnits(Refusal):
    """Units differ in dimension or reference condition."""


class RegimeTooSparse(Refusal):
    """A regime has too few samples or no spread."""


class PopulationTooSparse(Refusal):
    """A population has too few windows."""


class ZeroSpreadBaseline(Refusal):
    """A baseline's scale is zero."""


class GroupLeakage(Refusal):
    """A group is in two folds."""


class AlignmentRefusal(Refusal):
    """Series don't share enough instants."""


class DesignTooSmall(Refusal):
    """A trial has too few assignments to decide anything."""


class ScheduleMismatch(Refusal):
    """A trial plan doesn't agree with itself."""


class NarratorUnavailable(Refusal):
    """No narrator endpoint is configured."""


REFUSALS = "step string, tags string, error_type string, cause string"
