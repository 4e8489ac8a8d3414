"""Gateway settings and their validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

PAGE_SIZE_MAX = 500


@dataclass
class GatewayConfig:
    """Defaults: pages of 100 rows, 30 s for a query (0: no limit), read-only."""

    name: str | None = None
    page_size: int = 100
    query_timeout: float | None = 30
    read_only: bool = True
    jdbc_options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, **given) -> GatewayConfig:
        """What is given, else what GNEISS_* variables say, else the defaults."""
        kinds = {"name": str, "page_size": int, "query_timeout": float, "read_only": lambda v: v.strip().lower() not in ("0", "false", "no")}
        found = {k: read(os.environ[f"GNEISS_{k.upper()}"]) for k, read in kinds.items() if f"GNEISS_{k.upper()}" in os.environ}
        return cls(**(found | given))

    def problems(self) -> list[str]:
        """All that is wrong, not the first thing only."""
        out = []
        if not 1 <= self.page_size <= PAGE_SIZE_MAX:
            out.append(f"page_size must be within 1..={PAGE_SIZE_MAX}, got {self.page_size}")
        if self.query_timeout is not None and self.query_timeout < 0:
            out.append("query_timeout must not be negative")
        if self.name is not None and not self.name.strip():
            out.append("name must not be blank")
        return out

    def validate(self) -> GatewayConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    def __repr__(self) -> str:
        shown = {k: "[redacted]" if k.lower() in ("password", "user", "url") else v for k, v in self.jdbc_options.items()}
        return f"GatewayConfig(name={self.name!r}, page_size={self.page_size}, query_timeout={self.query_timeout}, read_only={self.read_only}, jdbc_options={shown})"
