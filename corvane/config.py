"""Settings of an index: defaults, then the environment, then a file, then what the caller gives."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "CORVANE_"


@dataclass(frozen=True)
class Config:
    repo: str = "."
    branch: str = "HEAD"
    storage: str = ".corvane"
    max_commits: int | None = None
    commits_per_unit: int = 7
    max_unit_tokens: int = 5000
    max_diff_lines: int = 200
    max_files: int = 50
    max_message: int = 5000
    second_pass_min_commits: int = 8
    second_pass_max_share: float = 0.5
    resolution_threshold: float = 0.85
    module_depth: int | None = None
    resolutions: tuple[float, ...] = (0.5, 1.0, 2.0)
    min_community: int = 3
    parent_link: float = 0.3
    split_warning: float = 0.7
    summary_reuse: float = 0.7
    retries: int = 1
    concurrency: int = 4

    def checked(self) -> Config:
        """The same settings, or a ``ValueError`` that names all that are out of bounds."""
        least = {
            "max_unit_tokens": 100, "concurrency": 1, "min_community": 1, "retries": 0, "commits_per_unit": 1, "max_diff_lines": 1,
            "max_files": 1, "max_message": 1, "second_pass_min_commits": 1,
        }
        wrong = [f"{k} must be at least {v}" for k, v in least.items() if getattr(self, k) < v]
        shares = ("resolution_threshold", "parent_link", "split_warning", "summary_reuse", "second_pass_max_share")
        wrong += [f"{k} must be between 0 and 1" for k in shares if not 0 <= getattr(self, k) <= 1]
        if not self.resolutions:
            wrong.append("at least one resolution is needed")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def parsed_json(text: str | None, default):
    """The value of a JSON text, or the default where it can't be read."""
    try:
        return json.loads(text) if text else default
    except ValueError:
        return default


def load(environ: dict[str, str] | None = None, **given) -> Config:
    """Settings of a repository. ``given`` values of None are as good as not given; unknown names in the file are ignored."""
    environ = os.environ if environ is None else environ
    kinds = {f.name: f.type for f in fields(Config)}
    found: dict = {}
    for name, kind in kinds.items():
        if (value := environ.get(PREFIX + name.upper())) is not None:
            found[name] = tuple(map(float, value.split(","))) if "tuple" in kind else int(value) if "int" in kind else float(value) if kind == "float" else value
    given = {k: v for k, v in given.items() if v is not None}
    repo = Path(given.get("repo", found.get("repo", Config.repo))).resolve()
    file = repo / ".corvane" / "config.json"
    said = parsed_json(file.read_text(), {}) if file.exists() else {}
    said = {k: tuple(v) if k == "resolutions" else v for k, v in said.items() if k in kinds} if isinstance(said, dict) else {}
    config = replace(Config(), **(found | said | given))
    return replace(config, repo=str(repo), storage=str((repo / config.storage).resolve())).checked()
