"""GitHub locators and shallow clones."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import time
from typing import NamedTuple


class Repo(NamedTuple):
    owner: str
    name: str
    branch: str | None = None
    subpath: str | None = None


def parse(url: str) -> Repo:
    """https://github.com/owner/name, the same without https, git@github.com:owner/name and owner/name, each with or without .git;
    /tree/branch/subpath is read, other pages of the repository stand for all of it. ValueError for anything else."""
    rest = re.sub(r"[?#].*$", "", url.strip()).rstrip("/")
    rest, n = re.subn(r"^(?:https?://)?(?:www\.)?github\.com(?:/|$)|^git@github\.com:", "", rest)
    parts = [x for x in rest.split("/") if x]
    if len(parts) < 2 or (not n and len(parts) > 2) or not all(re.fullmatch(r"[\w.-]+", x) for x in parts[:2]):
        raise ValueError(f"not a GitHub repository: {url}")
    owner, name, *page = parts
    branch = page[1] if len(page) > 1 and page[0] == "tree" else None
    return Repo(owner, name.removesuffix(".git"), branch, "/".join(page[2:]) or None if branch else None)


def is_github(path: str) -> bool:
    """A local path of that name comes first."""
    if os.path.exists(path):
        return False
    return "github.com" in path or bool(re.fullmatch(r"[\w-]+/[\w-]+", path))


def _git(*args: str) -> None:
    subprocess.run(["git", *args], check=True, capture_output=True)


def clone(repo: Repo, cache: str, max_age: float = 3600, profile: str = "P", host: str = "https://github.com") -> str:
    """The folder of a shallow clone, or of its subpath. One older than max_age seconds is brought up to date: by a pull whose
    errors don't count (P), or by a fetch and a reset, and a new clone if they fail (B)."""
    at = os.path.join(cache, repo.owner, repo.name)
    git = os.path.join(at, ".git")
    there = os.path.isdir(git)
    if there and time.time() - os.path.getmtime(git) > max_age:
        try:
            if profile == "P":
                _git("-C", at, "pull")
            else:
                _git("-C", at, "fetch", "--depth", "1")
                _git("-C", at, "reset", "--hard", "origin/HEAD")
            os.utime(git)
        except subprocess.CalledProcessError:
            if profile == "B":
                shutil.rmtree(at)
                there = False
    if not there:
        branch = ["--branch", repo.branch] if repo.branch else []
        _git("clone", "--depth", "1", "--single-branch", *branch, f"{host}/{repo.owner}/{repo.name}.git", at)
    return os.path.join(at, repo.subpath) if repo.subpath else at
