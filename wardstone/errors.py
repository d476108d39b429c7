"""Error codes and the exception that carries one."""

from __future__ import annotations

from enum import Enum

Code = Enum(
    "Code",
    "CONFIG_ERROR PARSE_ERROR VALIDATION_ERROR UNSUPPORTED_STATEMENT LINEAGE_UNKNOWN REWRITE_ERROR IO_ERROR POLICY_SERVICE_UNAVAILABLE "
    "POLICY_INSTANCE_NOT_FOUND INTROSPECT_ERROR METADATA_INSTANCE_NOT_FOUND METADATA_INSTANCE_EXISTS METADATA_CREDENTIAL_UNAVAILABLE QUERY_TIMEOUT QUERY_FAILED",
)


class GovernanceError(Exception):
    def __init__(self, code: Code, message: str):
        super().__init__(f"{code.name}: {message}")
        self.code = code
