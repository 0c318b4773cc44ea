"""Settings: a JSON file; unknown keys are dropped, bad values fall back, numbers are clamped."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

from quarry import model as M

_CLAMPS = {"result_limit": (10, 5000), "max_file_mb": (1, 4096), "snippets_per_file": (1, 100)}


@dataclass
class Settings:
    result_limit: int = 200
    max_file_mb: int = 500
    snippets_per_file: int = 10
    optional_formats: bool = False
    hidden_files: bool = False
    docx_headers: bool = True

    def for_indexer(self) -> dict:
        """Options of an ``Indexer``."""
        extensions = M.CORE_EXTENSIONS + (M.OPTIONAL_EXTENSIONS if self.optional_formats else ())
        return {"extensions": extensions, "max_mb": self.max_file_mb, "allow_hidden": self.hidden_files, "docx_headers": self.docx_headers}

    def request(self, query: str, **options) -> M.Request:
        """A search with this limit and these snippets, unless it names others."""
        return M.Request(query, **({"limit": self.result_limit, "snippets_per_file": self.snippets_per_file} | options))


def load(path: str) -> Settings:
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        return Settings()
    out = Settings()
    for f in fields(Settings):
        value = raw.get(f.name) if isinstance(raw, dict) else None
        if type(value) is type(f.default):
            low, high = _CLAMPS.get(f.name, (value, value))
            setattr(out, f.name, min(max(value, low), high))
    return out


def save(path: str, settings: Settings) -> None:
    temp = f"{path}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f)
    os.replace(temp, path)
