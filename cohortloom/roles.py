"""Column roles of a panel: which column is the entity, which the period, and so on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Roles of the columns of a raw (all-string) panel table."""

    entity: str
    period: str
    numeric: list[str] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=lambda: ["year", "quarter"])

    def core_columns(self) -> list[str]:
        """Key, codes, numbers, texts: the stored order, without dropped or partition columns."""
        unwanted = set(self.drop) | set(self.partitions)
        ordered = [self.entity, self.period, *self.codes, *self.numeric, *self.text]
        return [c for c in ordered if c not in unwanted]

    def all_columns(self) -> list[str]:
        return self.core_columns() + list(self.partitions)
