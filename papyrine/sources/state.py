"""Small state files of the driver: atomic writes, locked updates, a cursor that never goes back."""

from __future__ import annotations

import copy
import fcntl
import hashlib
import json
import os
import tempfile
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame


class StateError(RuntimeError):
    """A state file that cannot be read."""


@dataclass(frozen=True)
class FetchOutcome:
    """Rows, and whether the fetch worked: an empty result is not a failed one."""

    rows: DataFrame | None
    ok: bool
    error: str = ""


def read_json(path: Path, default):
    if not Path(path).exists():
        return copy.deepcopy(default)
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise StateError(f"{path}: {e}") from e


def write_text(path: Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def write_json(path: Path, value) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


@contextmanager
def locked(path: Path):
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def update_json(path: Path, default, change):
    with locked(path):
        value = change(read_json(path, default))
        write_json(path, value)
        return value


def load_cursor(path: Path) -> datetime | None:
    """None on the first run, and where the file is not readable."""
    try:
        return datetime.fromisoformat(read_json(path, {})["last_success_utc"]).astimezone(UTC)
    except (StateError, KeyError, TypeError, ValueError):
        return None


def save_cursor(path: Path, to: datetime) -> None:
    def later(held: dict) -> dict:
        old = held.get("last_success_utc")
        new = max(to, datetime.fromisoformat(old)) if old else to
        return {"last_success_utc": new.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}

    update_json(path, {}, later)


def fetch_window(path: Path, now: datetime) -> tuple[datetime, datetime]:
    held = load_cursor(path)
    return min(now, held - timedelta(minutes=15) if held else now - timedelta(days=7)), now


def read_cache(path: Path, meta: dict) -> dict:
    """Entries of a cache of exactly this meta; empty if it differs or cannot be read."""
    try:
        held = read_json(path, {})
    except StateError:
        return {}
    return dict(held.get("entries", {})) if isinstance(held, dict) and held.get("_meta") == meta else {}


def merge_cache(path: Path, meta: dict, entries: dict) -> None:
    with locked(path):
        write_json(path, {"_meta": meta, "entries": read_cache(path, meta) | entries})


def file_sha256(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: A profile's fields with what they are where there is none, or none that is sound.
PROFILE = {"interest": "agents that plan", "liked": [], "disliked": [], "feedback": []}


def profile(value) -> dict:
    """A stored profile with every field of its kind; unknown fields are kept."""
    held = {**PROFILE, **(value if isinstance(value, dict) else {})}
    lists = {k: list(held[k]) if isinstance(held[k], list) else [] for k, v in PROFILE.items() if isinstance(v, list)}
    interest = held["interest"]
    return {**held, **lists, "interest": interest if isinstance(interest, str) and interest.strip() else PROFILE["interest"]}


def record_feedback(path: Path, shown: list[str], row: int, label: str, at: datetime) -> dict:
    """Adds a vote on a row (from 1) of the last list shown; the newest vote on an id counts."""
    if label not in ("up", "down"):
        raise ValueError(f"unknown label {label}")
    if not 1 <= row <= len(shown):
        raise IndexError(f"row {row} of {len(shown)}")
    vote = {"id": shown[row - 1], "label": label, "at": at.astimezone(UTC).isoformat()}

    def change(held) -> dict:
        found = profile(held)
        rest = {k: [i for i in found[k] if i != vote["id"]] for k in ("liked", "disliked")}
        rest["liked" if label == "up" else "disliked"].append(vote["id"])
        return {**found, **rest, "feedback": [*found["feedback"], vote]}

    return update_json(path, {}, change)


def save_labels(path: Path, known: set[str], labels: dict[str, str]) -> dict:
    """Merges judgments (rel or irrel) of known ids into a file."""
    if bad := [i for i, v in labels.items() if i not in known or v not in ("rel", "irrel")]:
        raise ValueError(f"no such id or label: {sorted(bad)}")
    return update_json(path, {}, lambda held: {**held, **labels})


def weights(text: str) -> list[float]:
    """Numbers between commas; blanks are left out, none is an error."""
    found = [float(x) for x in text.split(",") if x.strip()]
    if not found:
        raise ValueError("no weights")
    return found
