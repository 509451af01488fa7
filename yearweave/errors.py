"""Blocking failures. `reason` is the value that also appears in the load report."""


class SourceFailure(Exception):
    """A mandatory source cannot be used."""

    def __init__(self, label: str, reason: str, detail: str):
        self.label = label
        self.reason = reason
        self.detail = detail
        super().__init__(f"source '{label}': {reason}: {detail}")


class ContractFailure(Exception):
    """The matches contract does not have the columns it must have."""


class NonPositiveFailure(Exception):
    """The x axis holds values without a logarithm."""


class SuffixTableFailure(Exception):
    """A suffix table is empty, or holds a factor that is not a number."""


class ParameterFailure(Exception):
    """A run parameter breaks its constraint."""
