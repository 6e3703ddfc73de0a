"""Row-level access predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    tenant: str
    subject: str = ""
    roles: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    authenticated: bool = False
    tokens: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        found = [f"subject:{self.subject}", *(f"role:{r}" for r in self.roles), *(f"group:{g}" for g in self.groups)]
        object.__setattr__(self, "tokens", tuple(dict.fromkeys(found)) if self.authenticated else ())


def may_read(p: Principal, tenant: str = "tenant_id", visibility: str = "visibility", readers: str = "acl_readers") -> Column:
    """Same tenant, and public, or for the signed-in also tenant-wide or naming them; a predicate that reaches the scan where it can."""
    seen = F.col(visibility) == "public"
    if p.authenticated:
        seen = seen | (F.col(visibility) == "tenant")
        seen = seen | ((F.col(visibility) == "private") & F.arrays_overlap(F.col(readers), F.array(*map(F.lit, p.tokens))))
    return (F.col(tenant) == p.tenant) & seen


def one_of(column: str, values: list[str]) -> Column:
    """Membership among the values that are not blank; no such value: no restriction."""
    named = [v.strip() for v in values if v.strip()]
    return F.col(column).isin(named) if named else F.lit(True)
