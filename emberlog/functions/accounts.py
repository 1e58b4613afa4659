"""Accounts, groups and paths: tests on event columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import prop
from .text import blank, contains_any, sam_account_name

# Security ids of services, their beginnings, and names of built-in accounts.
SERVICE_SIDS = (
    "S-1-5-7", "S-1-5-17", "S-1-5-18", "S-1-5-19", "S-1-5-20", "S-1-5-80",
    "S-1-5-80-956008885-3418522649-1831038044-1853292631-2271478464", "S-1-5-84-0-0-0-0-0", "S-1-5-90-0", "S-1-5-96-0",
)
SERVICE_SID_PREFIXES = ("S-1-5-80-", "S-1-5-82-", "S-1-5-83-", "S-1-5-84-", "S-1-5-90-", "S-1-5-96-")
SERVICE_NAMES = (
    "SYSTEM", "СИСТЕМА", "ANONYMOUS LOGON", "АНОНИМНЫЙ ВХОД", "LOCAL SERVICE", "ЛОКАЛЬНАЯ СЛУЖБА", "NETWORK SERVICE", "СЕТЕВАЯ СЛУЖБА",
    "IUSR", "IUSR_MACHINE", "DefaultAppPool", "TrustedInstaller", "FONT DRIVER HOST", "WINDOW MANAGER",
)
SERVICE_NAME_PREFIXES = ("DWM-", "UMFD-", "IUSR_", "IWAM_")
PRIVILEGED_SIDS = ("S-1-5-32-544", "S-1-5-32-548", "S-1-5-32-551", "S-1-5-32-555")
PRIVILEGED_RIDS = ("512", "518", "519")
PRIVILEGED_GROUPS = (
    "Administrators", "Администраторы", "Domain Admins", "Администраторы домена", "Enterprise Admins", "Администраторы предприятия",
    "Schema Admins", "Администраторы схемы", "Backup Operators", "Операторы архива", "Операторы резервного копирования",
    "Account Operators", "Операторы учета", "Операторы учёта", "Remote Desktop Users",
    "Пользователи удаленного рабочего стола", "Пользователи удалённого рабочего стола",
)
PROFILE_PATHS = ("\\Temp\\", "\\AppData\\Local\\Temp\\", "\\AppData\\", "\\Downloads\\", "\\Загрузки\\", "\\Documents\\", "\\Документы\\", "\\Desktop\\", "\\Рабочий стол\\")


def _listed(text: Column, whole: Sequence[str], beginnings: Sequence[str], end: str | None = None) -> Column:
    """Whether a lower-case text is one of a list or begins with one of another; it is worked out once for all tests."""

    def test(t: Column) -> Column:
        out = t.isin(*(x.lower() for x in whole))
        for p in beginnings:
            out = out | t.startswith(p.lower())
        return out if end is None else out | t.endswith(end)

    return F.coalesce(F.exists(F.array(text), test), F.lit(False))


def is_service_sid(sid: Column) -> Column:
    return _listed(F.lower(F.trim(sid)), SERVICE_SIDS, SERVICE_SID_PREFIXES)


def is_service_name(user: Column) -> Column:
    return ~blank(user) & _listed(F.lower(sam_account_name(user)), SERVICE_NAMES, SERVICE_NAME_PREFIXES, "$")


def is_machine_account() -> Column:
    """By the target's security id if it has a real one, else by subject and names."""
    target = F.trim(prop("TargetUserSid"))
    real = (target != "") & (F.lower(target) != "s-1-0-0")
    other = is_service_sid(prop("SubjectUserSid")) | is_service_name(F.col("user_name"))
    return is_service_name(F.col("target_user_name")) | F.when(real, is_service_sid(target)).otherwise(other)


def is_privileged_sid(sid: Column) -> Column:
    s = F.trim(sid)
    rid = F.regexp_extract(s, r"-([^-]+)$", 1)
    return F.coalesce(F.lower(s).isin(*(x.lower() for x in PRIVILEGED_SIDS)) | rid.isin(*PRIVILEGED_RIDS), F.lit(False))


def is_privileged_group(name: Column, sid: Column | None = None, more: Sequence[str] = ()) -> Column:
    named = ~blank(name) & contains_any(F.lower(name), (*PRIVILEGED_GROUPS, *(m for m in more if m.strip())))
    return named if sid is None else is_privileged_sid(sid) | named


def _fragments(configured: Sequence[str]) -> list[str]:
    seen: dict[str, str] = {}
    for f in (*PROFILE_PATHS, *configured):
        if f.strip():
            seen.setdefault(f.lower(), f)
    return list(seen.values())


def in_suspicious_path(text: Column, configured: Sequence[str] = ()) -> Column:
    return contains_any(F.lower(text), _fragments(configured))


def suspicious_paths(text: Column, configured: Sequence[str] = ()) -> Column:
    """The fragments that a text holds, in list order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, _fragments(configured))), lambda f: F.contains(low, F.lower(f)))


def account_key() -> Column:
    name = F.lower(F.coalesce("target_user_name", "user_name", F.lit("")))
    return F.concat(F.lower(F.coalesce("target_domain_name", "domain", F.lit(""))), F.lit("\\"), name)


def ip_key() -> Column:
    return F.lower(F.trim(F.coalesce("source_ip", F.lit(""))))
