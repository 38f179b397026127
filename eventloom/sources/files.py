"""Files outside Spark: configuration, downloads, archives, digests."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import tomllib
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

LANGS = ("ja", "en")


def load_toml(path: str | Path) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def sha256_file(path: str | Path, size: int = 1 << 20) -> str:
    with open(path, "rb") as f:
        digest = hashlib.sha256()
        while part := f.read(size):
            digest.update(part)
    return digest.hexdigest()


def stamped(base: str, stamp: str, suffix: str = ".zip") -> str:
    """A file's name with its stamp, if there is one, and suffix."""
    return f"{base}_{stamp}{suffix}" if stamp else f"{base}{suffix}"


@dataclass
class Download:
    label: str
    url: str
    path: str
    bytes: int
    sha256: str
    downloaded_at: str


def download(url: str, path: str | Path, label: str = "", timeout: float = 60, retries: int = 3, backoff: float = 1.5, agent: str = "eventloom", opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> Download:
    """Fetches a file by way of a .part file; retries is how often it is tried again, after pauses that double each time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    for attempt in range(max(retries, 0) + 1):
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out)
            os.replace(part, path)
            return Download(label, url, str(path), path.stat().st_size, sha256_file(path), datetime.now(timezone.utc).isoformat())
        except OSError as e:
            part.unlink(missing_ok=True)
            failed = e
            sleep(backoff * 2**attempt)
    raise RuntimeError(f"{url} failed {max(retries, 0) + 1} times") from failed


def write_alias(source: str | Path, alias: str | Path, overwrite: bool = True) -> None:
    """A copy under the name of the latest file."""
    if overwrite or not Path(alias).exists():
        shutil.copyfile(source, alias)


def safe_unzip(archive: str | Path, folder: str | Path, overwrite: bool = False) -> list[str]:
    """Extracts an archive; names that leave the folder raise ValueError, existing files FileExistsError, before anything is written."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        for m in members:
            target = (root / m.filename).resolve()
            if not target.is_relative_to(root):
                raise ValueError(f"{m.filename!r} lies outside the folder")
            if target.exists() and not overwrite:
                raise FileExistsError(target)
        for m in members:
            target = root / m.filename
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(m) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
    return [m.filename for m in members]


def write_manifest(path: str | Path, downloads: list[Download], files: dict[str, list[str]]) -> None:
    Path(path).write_text(json.dumps({"downloads": [asdict(d) for d in downloads], "extracted": files}, indent=2), encoding="utf-8")


def reference_dir(root: str | Path) -> Path:
    """Where code lists lie under a project's root, whichever case its data folder has."""
    upper = Path(root) / "Data" / "reference" / "edinet"
    return upper if upper.exists() or not (Path(root) / "data").exists() else Path(root) / "data" / "reference" / "edinet"


def codelist_dir(root: str | Path, lang: str = "ja") -> Path:
    if lang not in LANGS:
        raise ValueError(f"lang is one of {LANGS}, not {lang!r}")
    return reference_dir(root) / f"Edinetcode_{lang}_latest"


def codelist_csv(root: str | Path, lang: str = "ja") -> Path:
    return codelist_dir(root, lang) / "EdinetcodeDlInfo.csv"
