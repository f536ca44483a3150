"""The local side of a model hub: cache paths and lookups. Fetching is a function that the caller passes."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from contextlib import suppress
from pathlib import Path

FILES = ("tokenizer.json", "tokenizer_config.json", "vocab.json", "merges.txt")


class Hub:
    def __init__(self, cache: str | None = None, fetch: Callable[[str, str, str], bytes] | None = None, endpoint: str = "https://huggingface.co", timeout: int = 60):
        self.cache = Path(cache or os.path.expanduser("~/.cache/sparklex"))
        self.fetch, self.endpoint, self.timeout = fetch, endpoint, timeout

    def path(self, repo: str, name: str = "tokenizer.json") -> Path:
        return self.cache / repo.replace("/", "--") / name

    def is_cached(self, repo: str, name: str = "tokenizer.json") -> bool:
        return self.path(repo, name).exists()

    def download(self, repo: str, name: str = "tokenizer.json", revision: str = "main", local_files_only: bool = False) -> Path:
        at = self.path(repo, name)
        if not at.exists():
            if local_files_only or self.fetch is None:
                raise FileNotFoundError(f"{repo}/{name} is not in {self.cache}")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(self.fetch(repo, name, revision))
        return at

    def resolve(self, where: str, revision: str = "main", local_files_only: bool = False) -> Path:
        """A local path (in a directory, its tokenizer.json if there), or a repository's tokenizer.json; failing that its vocab.json, with merges.txt beside it if that can be had."""
        p = Path(where)
        if p.exists():
            return p / FILES[0] if (p / FILES[0]).is_file() else p
        try:
            return self.download(where, FILES[0], revision, local_files_only)
        except OSError:
            vocab = self.download(where, "vocab.json", revision, local_files_only)
        with suppress(OSError):
            self.download(where, "merges.txt", revision, local_files_only)
        return vocab

    def clear(self, repo: str) -> None:
        shutil.rmtree(self.path(repo).parent, ignore_errors=True)

    def clear_all(self) -> None:
        shutil.rmtree(self.cache, ignore_errors=True)
