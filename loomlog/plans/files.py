"""Small text files on the driver."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime
from pathlib import Path


def config_dir() -> str:
    return os.path.join(str(Path.home()), ".config", "loomlog")


def suggestions_path() -> str:
    return os.path.join(config_dir(), "last_suggestions.json")


def default_output(shell: str) -> str:
    """Where applied suggestions go unless told otherwise."""
    return os.path.join(str(Path.home()), ".loomlog_profile.ps1" if shell == "powershell" else ".loomlog_aliases.sh")


def ensure_dir(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def read_if_exists(path: str) -> str | None:
    try:
        return Path(path).read_text(encoding="utf-8")
    except OSError:
        return None


def read_json(path: str) -> object | None:
    """None if the file is missing or no JSON."""
    try:
        return json.loads(read_if_exists(path) or "")
    except ValueError:
        return None


def write(path: str, text: str) -> None:
    ensure_dir(os.path.dirname(os.path.abspath(path)))
    Path(path).write_text(text, encoding="utf-8")


def write_json(path: str, value: object) -> None:
    write(path, json.dumps(value, indent=2, ensure_ascii=False))


def backup(path: str) -> str | None:
    """Copy to .backup, or to a dated name if that exists."""
    if not os.path.exists(path):
        return None
    target = f"{path}.backup"
    if os.path.exists(target):
        target = f"{path}.{datetime.now(UTC):%Y%m%dT%H%M%S%f}.backup"
    shutil.copy2(path, target)
    return target


def append(path: str, text: str) -> None:
    ensure_dir(os.path.dirname(os.path.abspath(path)))
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"\n\n# ---- added {datetime.now(UTC):%Y-%m-%d %H:%M:%S} ----\n{text}")


def exists(path: str) -> bool:
    return os.path.exists(path)
