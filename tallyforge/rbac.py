"""Roles and what they permit, checked before a statement runs."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Permissions in rising order; who holds one holds those before it.
PERMISSIONS = ("CreateSession", "ViewDatabase", "WriteDatabase", "CreateOrAlterTable", "ExportData", "CreateOrAlterView")
#: Roles in rising order, each with its highest permission.
ROLES = {"DomainUser": "ViewDatabase", "DomainAdmin": "ExportData", "SystemAdmin": "CreateOrAlterView"}


class Denied(PermissionError):
    pass


@dataclass
class Roles:
    """Grants: a user's role in each database. A system administrator is one in all of them. While there are no grants, nothing
    is checked."""

    grants: dict[str, dict[str, str]] = field(default_factory=dict)

    def role(self, user: str, database: str) -> str | None:
        own = self.grants.get(user, {})
        return "SystemAdmin" if "SystemAdmin" in own.values() else own.get(database)

    def _level(self, role: str | None) -> int:
        return list(ROLES).index(role) if role is not None else -1

    def grant(self, user: str, role: str, database: str = "*", by: str | None = None) -> None:
        """Give a role. by: who gives it, to others only and no role above their own; None for the owner of the system."""
        if role not in ROLES:
            raise ValueError(f"no role {role}")
        if not user or (not database and role != "SystemAdmin"):
            raise ValueError("a user and a database are needed")
        if by is not None:
            if by == user:
                raise Denied("nobody gives roles to themselves")
            if self._level(role) > self._level(self.role(by, database)):
                raise Denied(f"{by} may not give a role above their own")
        self.grants.setdefault(user, {})[database] = role

    def revoke(self, user: str, database: str = "*", by: str | None = None) -> None:
        if by is not None and self._level(self.role(user, database)) > self._level(self.role(by, database)):
            raise Denied(f"{by} may not take a role above their own")
        self.grants.get(user, {}).pop(database, None)

    def permits(self, user: str, permission: str, database: str) -> bool:
        role = self.role(user, database)
        return role is not None and PERMISSIONS.index(permission) <= PERMISSIONS.index(ROLES[role])

    def check(self, user: str, permission: str, database: str) -> None:
        if self.grants and not self.permits(user, permission, database):
            raise Denied(f"user {user} lacks {permission} on database {database}")
