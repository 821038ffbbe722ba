"""Small TOML files on the driver: collections, mounts, jobs, settings."""

from __future__ import annotations

import json
import re
import shutil
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from vellum.operators.records import Field, ValidationError

TYPES = ("string", "number", "bool", "date", "enum", "tags", "ref")


@dataclass
class Collection:
    name: str
    path: str
    description: str = ""
    fields: list[Field] = field(default_factory=list)


def collection(name: str, text: str) -> Collection:
    raw = tomllib.loads(text)
    fields = [Field(f["name"], f.get("type", "string"), bool(f.get("required")), tuple(f.get("enum", ()))) for f in raw.get("fields", [])]
    for f in fields:
        if f.type not in TYPES:
            raise ValidationError(f"{name}: unknown type {f.type!r} of {f.name}")
    return Collection(name, raw.get("path", name).strip("/"), raw.get("description", ""), fields)


def collections(root: str) -> list[Collection]:
    """The collections declared under root, a folder with a config.toml each, by name."""
    return [collection(p.parent.name, p.read_text(encoding="utf-8")) for p in sorted(Path(root).glob("*/config.toml"))]


def save_collection(root: str, c: Collection) -> Path:
    """Register a collection or replace its schema; records are not touched."""
    folder = _named(root, c.name)
    if not c.path.strip():
        raise ValidationError(f"{c.name}: a path is required")
    lines = [f"path = {json.dumps(c.path.strip())}", f"description = {json.dumps(c.description)}"]
    for f in c.fields:
        if not f.name.strip() or f.type not in TYPES:
            raise ValidationError(f"{c.name}: field {f.name!r} of type {f.type!r}")
        lines += ["", "[[fields]]", f"name = {json.dumps(f.name)}", f"type = {json.dumps(f.type)}", f"required = {json.dumps(f.required)}"]
        lines += [f"enum = {json.dumps(list(f.enum))}"] if f.enum else []
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config.toml").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return folder


def remove_collection(root: str, name: str) -> None:
    """Forget a collection; records are not touched."""
    folder = _named(root, name)
    if not folder.is_dir():
        raise ValidationError(f"no collection {name!r}")
    shutil.rmtree(folder)


def _named(root: str, name: str) -> Path:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        raise ValidationError(f"{name!r} is no name of a collection")
    return Path(root) / name


@dataclass
class MountFile:
    """How a mount is launched and what it says of itself."""

    name: str
    command: str
    args: list[str] = field(default_factory=list)
    env: dict[str, str] = field(default_factory=dict)
    tool: str = "query"
    description: str = ""
    keywords: list[str] = field(default_factory=list)


def mounts(root: str) -> list[MountFile]:
    """The mounts declared under root, by name."""
    out = []
    for name, raw in _folders(root):
        if not raw.get("command"):
            raise ValidationError(f"mount {name}: a command is required")
        out.append(MountFile(name, raw["command"], raw.get("args", []), raw.get("env", {}), raw.get("tool") or "query", raw.get("description", ""), raw.get("keywords", [])))
    return out


#: What each kind of job must name.
RUNS = {"command": "command", "exec": "exec", "agent": "prompt"}


@dataclass
class Job:
    name: str
    trigger: dict
    run: dict


def job(name: str, raw: dict) -> Job:
    run = raw.get("run", {})
    kind = run.get("kind", "")
    if kind not in RUNS:
        raise ValidationError(f"job {name}: unknown kind {kind!r}")
    if not run.get(RUNS[kind]):
        raise ValidationError(f"job {name}: run.{RUNS[kind]} is required")
    return Job(name, raw.get("trigger", {}), run)


def jobs(root: str) -> tuple[list[Job], list[str]]:
    """The jobs declared under root, by name, and what is wrong with those that cannot be read: one bad job stops no other."""
    good, bad = [], []
    for p in _files(root):
        try:
            good.append(job(p.parent.name, tomllib.loads(p.read_text(encoding="utf-8"))))
        except (ValidationError, tomllib.TOMLDecodeError) as e:
            bad.append(f"{p.parent.name}: {e}")
    return good, bad


#: Settings that a file need not name.
DEFAULTS = {"embed_model": "bge-m3", "reranker_url": "", "reranker_model": "", "source_root": "", "agents_dir": "docs/agents", "directory_indexes": {"filename": "INDEX.md", "mode": "managed-block"}}


def settings(path: str) -> dict:
    """A settings file over the defaults; blank values count as not named."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    named = lambda d: {k: v for k, v in d.items() if not (isinstance(v, str) and not v.strip())}
    out = DEFAULTS | named(raw)
    out["directory_indexes"] = DEFAULTS["directory_indexes"] | named(raw.get("directory_indexes", {}))
    out["agents_dir"] = out["agents_dir"].rstrip("/")
    return out


def _files(root: str) -> list[Path]:
    return sorted(Path(root).glob("*/config.toml"))


def _folders(root: str) -> list[tuple[str, dict]]:
    return [(p.parent.name, tomllib.loads(p.read_text(encoding="utf-8"))) for p in _files(root)]
