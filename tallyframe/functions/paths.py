"""Paths as column expressions: parts, Windows and WSL forms, providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a provider in the name of a mount, in the order of tests.
MOUNT_HINTS = (("google", "gdrive"), ("one", "onedrive"), ("dropbox", "dropbox"))
# Providers with a source type of their own, and those counted as local.
OWN_SOURCE_TYPES = ("windows", "wsl", "gdrive", "onedrive", "dropbox")
LOCAL_SOURCES = ("local", "ssh", "rclone")
EXTERNAL_ROOTS = ("/mnt/", "/media/", "/run/media/")


def base_name(path: Column) -> Column:
    """The part after the last slash, trailing slashes aside."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def parent_name(path: Column) -> Column:
    """The name of the directory that a path is in; empty at the top."""
    return F.coalesce(F.try_element_at(F.filter(F.split(F.regexp_replace(path, "/+$", ""), "/"), lambda x: x != ""), F.lit(-2)), F.lit(""))


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty for dotfiles and for names that end in a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def is_windows(path: Column) -> Column:
    return path.startswith("\\\\") | (F.substring(path, 2, 1) == ":")


def is_wsl(path: Column) -> Column:
    """At least three parts, the root and mnt first."""
    return F.regexp_like(path, F.lit("^/+mnt/+[^/]"))


def extended_length(path: Column) -> Column:
    """Windows paths with the prefix that lifts their limit of length; other paths as they are."""
    prefix = "\\\\?\\"
    unc = F.concat(F.lit(prefix + "UNC\\"), F.regexp_replace(path, r"^\\+", ""))
    return F.when(~is_windows(path) | path.startswith(prefix), path).when(path.startswith("\\\\"), unc).otherwise(F.concat(F.lit(prefix), path))


def windows_to_wsl(path: Column) -> Column:
    drive = F.lower(F.substring(path, 1, 1))
    rest = F.regexp_replace(F.regexp_replace(F.substring(path, 3, 1 << 20), r"[\\/]+", "/"), "^/|/$", "")
    return F.concat(F.lit("/mnt/"), drive, F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest)))


def wsl_to_windows(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "\\")
    return F.when(is_wsl(path), F.concat(F.upper(F.get(parts, 1)), F.lit(":\\"), rest)).otherwise(path)


def provider_hint(mount: Column) -> Column:
    name = F.lower(base_name(mount))
    out = F.lit(None).cast("string")
    for text, provider in reversed(MOUNT_HINTS):
        out = F.when(F.contains(name, F.lit(text)), provider).otherwise(out)
    return out


def source_type(provider: Column, root: Column) -> Column:
    p = F.lower(provider)
    external = F.lit(False)
    for prefix in EXTERNAL_ROOTS:
        external = external | root.startswith(prefix)
    return F.when(p.isin(*OWN_SOURCE_TYPES), p).when(root.startswith("\\\\"), "network").when(external, "external").when(p.isin(*LOCAL_SOURCES), "local").otherwise("provider")


def detected_provider(target: Column) -> Column:
    """The first provider, by name, that takes a scan target; null if none does."""
    low = F.lower(target)
    return (
        F.when(F.contains(low, F.lit("dropbox")), "dropbox")
        .when(F.contains(low, F.lit("google drive")) | F.regexp_like(suffix(target), F.lit(r"^\.g(doc|sheet|slides|draw|form|site|shortcut)$")), "gdrive")
        .when(F.contains(low, F.lit("onedrive")), "onedrive")
        .when(F.substring(target, 2, 1) == ":", "windows")
        .when(is_wsl(target), "wsl")
    )


def scan_route(target: Column, providers: Sequence[str] = OWN_SOURCE_TYPES) -> Column:
    """Which scanner a target goes to: a scheme, a provider's name, a form, a name in the path, or a local path."""
    low = F.lower(target)
    return (
        F.when(target.startswith("ssh://"), "ssh")
        .when(target.startswith("rclone://"), "rclone")
        .when(target.isin(*providers), target)
        .when(is_windows(target), "windows")
        .when(is_wsl(target), "wsl")
        .when(F.contains(low, F.lit("google drive")), "gdrive")
        .when(F.contains(low, F.lit("onedrive")), "onedrive")
        .when(F.contains(low, F.lit("dropbox")), "dropbox")
        .when(target == "auto", "auto")
        .otherwise("local")
    )


def under_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path is one of the prefixes or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def canonical_path(root: str, digest: Column, algorithm: str = "sha256") -> Column:
    return F.concat(F.lit(root.rstrip("/") + f"/{algorithm}/"), digest)


def z_path_id(path: Column) -> Column:
    """The id in z://id; null for any other form or an empty id."""
    return F.when(path.startswith("z://"), F.nullif(F.trim(F.substring(path, 5, 1 << 20)), F.lit("")))


def move_end(provider: Column, path: Column) -> Column:
    return F.concat_ws(":", provider, path)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def short_name(path: Column, width: int = 40) -> Column:
    """A path cut from the left to fit a width, with an ellipsis for what is cut."""
    return F.when(F.char_length(path) <= width, path).otherwise(F.concat(F.lit("…"), F.substring(path, F.char_length(path) - F.lit(width - 2), F.lit(width - 1))))


def log_completion(line: Column) -> Column:
    """The number of the stage that a log line says is complete; null for others."""
    return F.nullif(F.regexp_extract(line, r"(?i)stage\s*([0-9]+)\s*complete", 1), F.lit("")).cast("int")
