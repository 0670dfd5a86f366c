"""Settings of an engine."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field
from enum import Enum

from .errors import DocumentValidationError


class Role(Enum):
    PRIMARY = "primary"
    SECONDARY = "secondary"


class SyncMethod(Enum):
    """Kept for callers that choose one; a commit is always one atomic publication."""

    FSYNC = "fsync"
    DSYNC = "dsync"
    NONE = "none"


@dataclass(frozen=True)
class LoggingConfig:
    enabled: bool = True
    sync_enabled: bool = True
    sync_method: SyncMethod = SyncMethod.FSYNC


@dataclass(frozen=True)
class ReplicationConfig:
    role: Role = Role.PRIMARY
    node_name: str = "node"
    primary_hint: str | None = None
    sync_source: str | None = None
    term: int = 1

    def __post_init__(self) -> None:
        if self.role is Role.SECONDARY and not self.sync_source:
            raise DocumentValidationError("a secondary needs a sync source")


@dataclass(frozen=True)
class EngineConfig:
    logging: LoggingConfig = field(default_factory=LoggingConfig)
    replication: ReplicationConfig = field(default_factory=ReplicationConfig)

    @classmethod
    def from_arguments(cls, arguments: list[str] | None = None) -> tuple[str, EngineConfig]:
        """Path and settings from a command line, with environment variables TESSERA_* as defaults."""
        env = lambda name, default=None: os.environ.get(f"TESSERA_{name}", default)
        parser = argparse.ArgumentParser(prog="tessera")
        parser.add_argument("--db-path", default=env("DB_PATH", "tessera-data"))
        parser.add_argument("--role", choices=[r.value for r in Role], default=env("ROLE", Role.PRIMARY.value))
        parser.add_argument("--node-name", default=env("NODE_NAME", "node"))
        parser.add_argument("--primary-hint", default=env("PRIMARY_HINT"))
        parser.add_argument("--sync-source", default=env("SYNC_SOURCE"))
        a = parser.parse_args(arguments)
        return a.db_path, cls(replication=ReplicationConfig(Role(a.role), a.node_name, a.primary_hint, a.sync_source))
