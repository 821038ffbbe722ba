"""Edits of note files on the driver, confined to one folder (A26), by verbs that are followed by a refresh of their paths."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from vellum.operators.records import ValidationError


class Memory:
    def __init__(self, root: str):
        self.root = Path(root).resolve()

    def _safe(self, path: str) -> Path:
        full = (self.root / path.lstrip("/")).resolve()
        if full != self.root and self.root not in full.parents:
            raise ValidationError(f"{path!r} is outside of the notes")
        return full

    def view(self, path: str) -> str:
        full = self._safe(path)
        if full.is_dir():
            return "\n".join(sorted(p.name + "/" * p.is_dir() for p in full.iterdir() if not p.name.startswith(".")))
        return full.read_text(encoding="utf-8")

    def create(self, path: str, text: str) -> None:
        full = self._safe(path)
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text, encoding="utf-8")

    def append(self, path: str, text: str) -> None:
        full = self._safe(path)
        old = full.read_text(encoding="utf-8") if full.exists() else ""
        self.create(path, old + ("" if not old or old.endswith("\n") else "\n") + text)

    def str_replace(self, path: str, old: str, new: str) -> None:
        text = self.view(path)
        if text.count(old) != 1:
            raise ValidationError(f"the text occurs {text.count(old)} times, not once")
        self.create(path, text.replace(old, new))

    def insert(self, path: str, line: int, text: str) -> None:
        lines = self.view(path).split("\n")
        if not 0 <= line <= len(lines):
            raise ValidationError(f"line {line} is not in 0..{len(lines)}")
        self.create(path, "\n".join([*lines[:line], text.rstrip("\n"), *lines[line:]]))

    def delete(self, path: str) -> None:
        full = self._safe(path)
        if full == self.root:
            raise ValidationError("the folder itself can't be deleted")
        full.unlink()

    def rename(self, path: str, to: str) -> None:
        target = self._safe(to)
        if target.exists():
            raise ValidationError(f"{to!r} exists")
        target.parent.mkdir(parents=True, exist_ok=True)
        self._safe(path).rename(target)

    def run(self, verb: str, refresh: Callable[[str], None] = lambda path: None, **given) -> str:
        """One verb with its arguments; refresh(path) is called for each path that a write touched."""
        path, to = given.get("path", ""), given.get("to", "")
        done = {"create": f"created {path}", "append": f"appended to {path}", "str_replace": f"replaced in {path}", "insert": f"inserted into {path}", "delete": f"deleted {path}", "rename": f"renamed {path} -> {to}"}
        if verb == "view":
            return self.view(**given)
        if verb not in done:
            raise ValidationError(f"unknown verb {verb!r}")
        getattr(self, verb)(**given)
        for p in (path, to) if verb == "rename" else (path,):
            refresh(p)
        return done[verb]
