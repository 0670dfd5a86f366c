"""What the engine raises."""


class EngineError(Exception):
    """Any failure that a command reports as code 8000."""


class DocumentValidationError(EngineError):
    """A document, filter, update or name breaks the rules."""


class StorageError(EngineError):
    """A stored object is missing, exists already, or collides."""


class ProtocolError(EngineError):
    """A command or cursor request is malformed."""


class TransactionStateError(EngineError):
    """A transaction is begun within another, or used after its end."""


class ConflictError(StorageError):
    """Another writer published first."""


class NotLeaderError(EngineError):
    """A write reached an engine that only follows."""

    def __init__(self, leader_hint: str | None = None) -> None:
        super().__init__("not primary" + (f"; primary is {leader_hint}" if leader_hint else ""))
        self.leader_hint = leader_hint
