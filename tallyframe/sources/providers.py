"""Scans by provider: the walk source with what each kind of store adds, and the choice of a scanner for a target."""

from __future__ import annotations

import importlib
import itertools
import json
import os
import pkgutil
import shlex
import subprocess
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import classify as K
from tallyframe.functions import digests, ids, paths
from tallyframe.sources.walk import LOCAL_EXCLUDED, WINDOWS_EXCLUDED, best_digest, walk

Scanner = Callable[[SparkSession, str], DataFrame]


def records(files: DataFrame, provider: str, root: str, source: str | None = None, path: Column | None = None, pointers: bool = False, extra: dict[str, Column] | None = None, device: str | None = None, label: str | None = None) -> DataFrame:
    """File records of walked files, with metadata (JSON of path, provider and extra). Ids follow from source, path and time. The key
    blake3 is what manifests call the content's digest; hash_algorithm says what it is. A file that could not be read has stat_error in its
    metadata and the digest of that in place of its content's."""
    p = F.col("path")
    source = source or f"{provider}://{root}"
    device_id = F.lit(device) if device else digests.digest(digests.canonical_json(provider=F.lit(provider), root=F.lit(root)))
    name = label or os.path.basename(root.rstrip("/")) or root
    broken = F.col("error").isNotNull()
    meta = F.to_json(F.struct(p.alias("path"), F.lit(provider).alias("provider"), "is_symlink", "size", "mtime", "mode", F.when(broken, F.lit(True)).alias("stat_error"), *(c.alias(k) for k, c in (extra or {}).items())))
    stand_in = digests.metadata_digest(path=p, provider=F.lit(provider), stat_error=F.lit(True))
    files = files.withColumn("hash_algorithm", F.when(broken, stand_in["algorithm"]).otherwise(F.col("hash_algorithm"))).withColumn("digest", F.when(broken, stand_in["digest"]).otherwise(F.col("digest")))
    rows = files.withColumn("mime_type", K.mime_type(p, pointers)).withColumn("category", K.category(p, K.mime_type(p)))
    return rows.select(
        ids.id_at(F.floor(F.coalesce("mtime", F.lit(0.0)) * 1000).cast("long"), F.concat_ws("|", F.lit(source), p)).alias("uuid7"),
        (p if path is None else path).alias("path"),
        F.lit(source).alias("source"),
        "size", "mtime", "mode", "hash_algorithm", F.col("digest").alias("blake3"), "category", "mime_type", K.shortcut_allowed(F.col("category")).alias("shortcut_allowed"), "sha256",
        digests.source_id(F.lit(provider), F.lit(root), device_id, F.lit(label)).alias("source_id"),
        paths.source_type(F.lit(provider), F.lit(root)).alias("source_type"),
        F.lit(name).alias("source_label"),
        device_id.alias("source_device_uuid"),
        meta.alias("metadata"),
    )


def scan_local(spark: SparkSession, root: str) -> DataFrame:
    return records(walk(spark, root, LOCAL_EXCLUDED, digest=best_digest(), errors=True), "local", root, source=root)


def _suffix_in(*values: str) -> Column:
    return paths.suffix(F.col("path")).isin(*values)


def _some_part_in(names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.transform(F.split("path", r"[/\\]"), F.lower), F.array(*map(F.lit, names)))


def scan_windows(spark: SparkSession, root: str) -> DataFrame:
    extra = {"hidden": F.col("name").startswith("."), "system_like": _some_part_in(WINDOWS_EXCLUDED), "onedrive_placeholder": _suffix_in(".cloud", ".url")}
    return records(walk(spark, root, WINDOWS_EXCLUDED, digest=best_digest(), errors=True), "windows", root, path=paths.extended_length(F.col("path")), extra=extra)


def scan_wsl(spark: SparkSession, root: str = "/mnt/c") -> DataFrame:
    return records(walk(spark, root, (), digest=best_digest(), errors=True), "wsl", root, extra={"windows_path": paths.wsl_to_windows(F.col("path")), "case_sensitive_path": F.col("path")})


def _descriptor() -> Column:
    """What a cloud drive's pointer file says: its JSON if it is that, else its text; null if it can't be read."""

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        def read(path: str) -> str | None:
            try:
                f = open(path, "rb")
            except OSError:
                return None
            with f:
                text = f.read().decode("utf-8", "ignore")
            try:
                return json.dumps(json.loads(text), sort_keys=True)
            except ValueError:
                return text

        return names.map(lambda p: None if p is None else read(p))

    return of(F.when(_suffix_in(*K.POINTER_MIME), F.col("path")))


def _cloud(provider: str, extra: Callable[[], dict[str, Column]], pointers: bool = False) -> Scanner:
    def scan(spark: SparkSession, root: str) -> DataFrame:
        account = json.dumps({"kind": "cloud-root", "provider": provider, "root": root}, separators=(",", ":"))
        import hashlib

        return records(walk(spark, root, (), digest=best_digest(), errors=True), provider, root, pointers=pointers, extra=extra(), device=hashlib.sha256(account.encode()).hexdigest())

    return scan


scan_gdrive = _cloud("gdrive", lambda: {"offline": F.lit(False), "pseudo_file": _suffix_in(*K.POINTER_MIME), "descriptor": _descriptor()}, pointers=True)
scan_onedrive = _cloud("onedrive", lambda: {"placeholder": _suffix_in(".url", ".cloud"), "selective_sync": F.array_contains(F.split("path", "/"), "archive")})
scan_dropbox = _cloud("dropbox", lambda: {"smart_sync": _suffix_in(".url", ".dropbox"), "online_only": _suffix_in(".dropbox")})

class Provider:
    """A kind of store: whether a target is one of its, how it is scanned, where it is by default, and what it can do."""

    name, version, capabilities, description = "provider", "1.0.0", ("scan",), "a store that can be scanned"

    def __init__(self, name: str, scan: Scanner, default: str | None = None, **about):
        self.name, self._scan, self._default = name, scan, default
        for k, v in about.items():
            setattr(self, k, v)

    def detect(self, spark: SparkSession, target: str) -> bool:
        return spark.range(1).select(paths.detected_provider(F.lit(target)).alias("p")).first()["p"] == self.name

    def scan(self, spark: SparkSession, target: str | None = None) -> DataFrame:
        at = target or self.default_target()
        if at is None:
            raise FileNotFoundError(f"{self.name}: no target given and none there by default")
        return self._scan(spark, at)

    def default_target(self) -> str | None:
        at = os.path.expanduser(self._default) if self._default else None
        return at if at and os.path.isdir(at) else None

    def metadata(self) -> dict:
        return {"name": self.name, "version": self.version, "capabilities": tuple(self.capabilities), "description": self.description}


_SCANNERS: dict[str, Provider] = {
    p.name: p
    for p in (
        Provider("windows", scan_windows, description="Windows paths, in their extended form"),
        Provider("wsl", scan_wsl, "/mnt/c", description="Windows drives as Linux mounts"),
        Provider("gdrive", scan_gdrive, "~/Google Drive", capabilities=("scan", "descriptors"), description="a synchronised drive with pointer files"),
        Provider("onedrive", scan_onedrive, "~/OneDrive", capabilities=("scan", "placeholders"), description="a synchronised drive with placeholders"),
        Provider("dropbox", scan_dropbox, "~/Dropbox", capabilities=("scan", "placeholders"), description="a synchronised drive with files that are online only"),
    )
}


def register(name: str, scanner: Scanner | Provider) -> None:
    """Adds a provider, or replaces one."""
    _SCANNERS[name] = scanner if isinstance(scanner, Provider) else Provider(name, scanner)


def discover(packages: tuple[str, ...] = (), group: str | None = None) -> tuple[str, ...]:
    """Adds the providers of other packages: those in each module of a package (or in a module itself), and those that installed distributions name under a group of
    entry points. A provider is an object of Provider, or a class of its own below it that needs no arguments. Returns the names added, in order of discovery."""
    found: list[object] = []
    for name in packages:
        module = importlib.import_module(name)
        inside = [importlib.import_module(f"{name}.{m.name}") for m in pkgutil.iter_modules(getattr(module, "__path__", []))]
        found += [v for m in (module, *inside) for v in vars(m).values()]
    if group:
        found += [e.load() for e in entry_points(group=group)]
    added = []
    for value in found:
        if isinstance(value, type) and issubclass(value, Provider) and value is not Provider and "name" in vars(value):
            value = value()
        if isinstance(value, Provider) and _SCANNERS.get(value.name) is not value:
            register(value.name, value)
            added.append(value.name)
    return tuple(added)


def providers() -> tuple[str, ...]:
    return tuple(sorted(_SCANNERS))


def provider(name: str) -> Provider:
    if name not in _SCANNERS:
        raise KeyError(f"unknown provider: {name}")
    return _SCANNERS[name]


def scanner(name: str) -> Scanner:
    return provider(name).scan


# ---- stores behind a command


def _lines(command: list[str]) -> Iterator[str]:
    """What a command writes, line by line as it comes; an error if it fails."""
    with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="surrogateescape") as run:
        for line in run.stdout:
            if line.strip():
                yield line.rstrip("\n")
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, command)


_LISTED = "path string, size long, mtime double, mode int"


def _listed(spark: SparkSession, parts: list[tuple[str, bool]], of: Callable[[str, bool], Iterator[tuple]]) -> DataFrame:
    """The files of parts of a store, (folder, whether with all below), each listed in a task of its own, so that only the names of the
    top folders pass through the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for folder, deep in zip(rows["folder"], rows["deep"], strict=True):
                found = of(folder, bool(deep))
                while some := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(some, columns=["path", "size", "mtime", "mode"])

    named = spark.createDataFrame(parts, "folder string, deep boolean").repartition(max(1, len(parts)), "folder")
    return named.mapInPandas(run, _LISTED)


def _digest_by(command: Callable[[str], list[str]]) -> Column:
    """The SHA-256 of what a command writes for a path, read in chunks in the tasks."""
    import hashlib

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            h = hashlib.sha256()
            with subprocess.Popen(command(path), stdout=subprocess.PIPE) as run:
                while chunk := run.stdout.read(1 << 20):
                    h.update(chunk)
            if run.returncode:
                raise subprocess.CalledProcessError(run.returncode, run.args)
            return h.hexdigest()

        return names.map(one)

    return of(F.col("path"))


def _remote(listed: DataFrame, source: str, digest: Column) -> DataFrame:
    p = F.col("path")
    rows = listed.repartition(F.col("path")).withColumn("sha256", digest).withColumn("mime_type", K.mime_type(p)).withColumn("category", K.category(p, F.col("mime_type")))
    key = F.concat_ws("|", F.lit(source), p)
    return rows.select(ids.id_at(F.floor(F.col("mtime") * 1000).cast("long"), key).alias("uuid7"), "path", F.lit(source).alias("source"), "size", "mtime", "mode", F.lit("sha256").alias("hash_algorithm"), F.col("sha256").alias("blake3"), "category", "mime_type", K.shortcut_allowed(F.col("category")).alias("shortcut_allowed"), "sha256")


def scan_ssh(spark: SparkSession, host: str, root: str, user: str | None = None, port: int = 22, identity: str | None = None, program: str = "ssh") -> DataFrame:
    """Files of a host: one remote command names the root's folders, tasks list and read what is in each. Modes are octal in the listing."""
    base = [program, "-p", str(port), *(["-i", identity] if identity else []), f"{user}@{host}" if user else host]

    def of(folder: str, deep: bool) -> Iterator[tuple]:
        depth = "" if deep else "-maxdepth 1 "
        for line in _lines([*base, f"find {shlex.quote(folder)} {depth}-type f -exec stat -c '%s %Y %a %n' {{}} +"]):
            size, mtime, mode, path = line.split(" ", 3)
            yield path, int(size), float(mtime), int(mode, 8)

    folders = list(_lines([*base, f"find {shlex.quote(root)} -mindepth 1 -maxdepth 1 -type d"]))
    listed = _listed(spark, [(root, False), *((f, True) for f in folders)], of)
    return _remote(listed, f"ssh://{host}{root}", _digest_by(lambda path: [*base, f"cat -- {shlex.quote(path)}"]))


def _items(lines: Iterator[str]) -> Iterator[dict]:
    """The objects of a JSON array written one to a line, or all in one."""
    for line in lines:
        text = line.strip()
        if text.startswith("[") and text.endswith("]"):
            yield from json.loads(text)
        elif text := text.removeprefix("[").removesuffix("]").rstrip(","):
            yield json.loads(text)


def scan_rclone(spark: SparkSession, remote: str, root: str, args: tuple[str, ...] = (), program: str = "rclone") -> DataFrame:
    """Files of a remote, without times and modes: the driver lists the root's folders, tasks list what is in each."""

    def items(folder: str, *more: str) -> Iterator[dict]:
        at = "/".join(x for x in (root.rstrip("/"), folder) if x)
        return _items(_lines([program, *args, "lsjson", f"{remote}:{at}", *more]))

    def of(folder: str, deep: bool) -> Iterator[tuple]:
        for i in items(folder, *(["--recursive"] if deep else [])):
            if not i.get("IsDir"):
                yield "/".join(x for x in (folder, i.get("Path") or "") if x), int(i.get("Size") or 0), 0.0, 0

    folders = [i["Path"] for i in items("", "--dirs-only") if i.get("IsDir")]
    listed = _listed(spark, [("", False), *((f, True) for f in folders)], of)
    whole = root.rstrip("/")
    return _remote(listed, f"rclone://{remote}/{root}", _digest_by(lambda path: [program, *args, "cat", f"{remote}:{whole}/{path}" if whole else f"{remote}:{path}"]))


def scan(spark: SparkSession, target: str) -> DataFrame:
    """The scan of a target: a scheme, a provider's name, or a path whose form or name tells the provider."""
    route = spark.range(1).select(paths.scan_route(F.lit(target), providers()).alias("r")).first()["r"]
    if route in ("ssh", "rclone"):
        host, _, path = target.split("://", 1)[1].partition("/")
        return scan_ssh(spark, host, f"/{path}") if route == "ssh" else scan_rclone(spark, host, path)
    if route == "auto":
        home = os.path.expanduser("~")
        for name, folder in (("dropbox", "Dropbox"), ("gdrive", "Google Drive"), ("gdrive", "My Drive"), ("onedrive", "OneDrive")):
            if os.path.isdir(os.path.join(home, folder)):
                return scanner(name)(spark, os.path.join(home, folder))
        raise FileNotFoundError("no provider found")
    if route == "local":
        if not os.path.exists(target):
            raise FileNotFoundError(f"unsupported scan target: {target}")
        return scan_local(spark, target)
    return scanner(route)(spark, target)
