"""What a file is, from its name: MIME type, category, whether a shortcut may stand for it."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.paths import base_name, parent_name, suffix

# Names and places that make a file part of the system, and suffixes by category.
SYSTEM_NAMES = ("$recycle.bin", "desktop.ini", "thumbs.db", ".ds_store")
SYSTEM_PREFIXES = (".", "~$")
SYSTEM_PARENTS = ("windows", "system32", "program files", "program files (x86)")
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs", ".sql", ".sh", ".ps1", ".yaml", ".yml", ".toml", ".json", ".xml", ".html", ".css")
MEDIA = (".mp3", ".mp4", ".mov", ".mkv", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".wav", ".flac")
CODE_MIME, MEDIA_MIME = ("text/", "application/json", "application/xml"), ("image/", "audio/", "video/")
NO_SHORTCUT = ("system", "binary")
UNKNOWN = "application/octet-stream"
# MIME types of a cloud drive's pointer files.
POINTER_MIME = {
    ".gdoc": "application/vnd.google-apps.document",
    ".gsheet": "application/vnd.google-apps.spreadsheet",
    ".gslides": "application/vnd.google-apps.presentation",
    ".gdraw": "application/vnd.google-apps.drawing",
    ".gform": "application/vnd.google-apps.form",
    ".gsite": "application/vnd.google-apps.site",
    ".gshortcut": "application/vnd.google-apps.shortcut",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(table.items()) for x in kv)), key)


def mime_type(path: Column, pointers: bool = False) -> Column:
    """By suffix, from the standard library's table of types; pointers: also a cloud drive's pointer files."""
    known = mimetypes.MimeTypes().types_map[True] | (POINTER_MIME if pointers else {})
    encoded = sorted(mimetypes.encodings_map)
    inner = F.when(suffix(path).isin(*encoded), suffix(F.regexp_replace(base_name(path), r"\.[^.]+$", ""))).otherwise(suffix(path))
    return F.coalesce(_lookup(inner, known), F.lit(UNKNOWN))


def is_system(path: Column) -> Column:
    name = F.lower(base_name(path))
    out = name.isin(*SYSTEM_NAMES) | F.lower(parent_name(path)).isin(*SYSTEM_PARENTS)
    for p in SYSTEM_PREFIXES:
        out = out | name.startswith(p)
    return out


def _starts(column: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | column.startswith(p)
    return out


def category(path: Column, mime: Column) -> Column:
    """The first that fits of system, code, media, binary and user; text of any kind counts as code."""
    s = suffix(path)
    return (
        F.when(is_system(path), "system")
        .when(s.isin(*CODE) | _starts(mime, CODE_MIME), "code")
        .when(s.isin(*MEDIA) | _starts(mime, MEDIA_MIME), "media")
        .when(mime == UNKNOWN, "binary")
        .otherwise("user")
    )


def shortcut_allowed(category_col: Column) -> Column:
    return ~category_col.isin(*NO_SHORTCUT)
