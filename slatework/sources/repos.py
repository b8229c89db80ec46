"""Repository listings and working copies: driver-side steps that end in small DataFrames."""

from __future__ import annotations

import base64
import json
import os
import re
import subprocess
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slatework.operators.joins import json_fields

LISTING = "name string, full_name string, default_branch string, description string, language string, archived boolean, fork boolean"
#: A page: (body, next page's address or none).
Fetch = Callable[[str], tuple[str, str | None]]


class ListingError(RuntimeError):
    """The listing service failed or answered with an error."""


class SyncError(RuntimeError):
    """A working copy could not be brought up to date."""


def next_link(header: str | None) -> str | None:
    """The address marked next in an HTTP Link header."""
    for part in (header or "").split(","):
        m = re.match(r'\s*<([^>]+)>\s*;.*rel="next"', part)
        if m:
            return m[1]
    return None


def http_fetch(token: str, timeout: float = 30.0) -> Fetch:
    """Pages over HTTPS with a bearer token."""
    import urllib.error
    import urllib.request

    def fetch(url: str) -> tuple[str, str | None]:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.read().decode(), next_link(r.headers.get("Link"))
        except (urllib.error.URLError, OSError) as e:
            raise ListingError(f"listing failed: {e}") from e

    return fetch


def pages(fetch: Fetch, first: str) -> Iterator[str]:
    """Bodies of all pages."""
    url: str | None = first
    while url:
        body, url = fetch(url)
        yield body


def list_organisation(spark: SparkSession, organisation: str, token: str, api: str = "https://api.github.com", per_page: int = 100, fetch: Fetch | None = None) -> DataFrame:
    """The active repositories of an organisation, page by page; raises ListingError."""
    first = f"{api}/orgs/{quote(organisation, safe='')}/repos?per_page={per_page}"
    return active_repos(listing(spark, list(pages(fetch or http_fetch(token), first))))


def listing(spark: SparkSession, bodies: list[str]) -> DataFrame:
    """Raw rows of listing pages (JSON arrays)."""
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    kind = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in LISTING.split(', '))}>>"
    return raw.select(F.explode(json_fields("body", kind)).alias("r")).select("r.*")


def active_repos(raw: DataFrame) -> DataFrame:
    """name, github_repo, default_branch, description, language: archived ones and forks left out, defaults filled in."""
    keep = ~F.coalesce("archived", F.lit(False)) & ~F.coalesce("fork", F.lit(False))
    default = lambda c, v: F.when(F.coalesce(c, F.lit("")) == "", v).otherwise(F.col(c))
    return raw.where(keep).select(
        "name", F.col("full_name").alias("github_repo"), default("default_branch", "main").alias("default_branch"), F.coalesce("description", F.lit("")).alias("description"),
        F.lower(default("language", "mixed")).alias("language"),
    )


class ListingSource(DataSource):
    """``spark.read.format("repo_listing").option("path", file)``: saved listing pages, one JSON array per file line."""

    @classmethod
    def name(cls) -> str:
        return "repo_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


class _ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)  # a path or an address that the executor reaches
        with system.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                for r in json.loads(line or "[]"):
                    yield tuple(r.get(c.split()[0]) for c in LISTING.split(", "))


def sync_working_copy(url: str, folder: str, branch: str = "main", timeout: float = 300.0, token: str | None = None) -> str:
    """Clone, or fetch and hard-reset, and return the commit; local edits are lost. Raises SyncError.

    A ``token`` is sent as a header that git reads from its environment, so it is in no argument, address or message.
    """
    env = dict(os.environ, GIT_TERMINAL_PROMPT="0")
    if token:
        secret = base64.b64encode(f"x-access-token:{token}".encode()).decode()
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Basic {secret}"}

    def git(*args: str, cwd: str | None = None) -> str:
        try:
            return subprocess.run(["git", *args], cwd=cwd, env=env, check=True, capture_output=True, text=True, timeout=timeout).stdout.strip()
        except subprocess.CalledProcessError as e:
            raise SyncError(f"git {args[0]} failed: {e.stderr.strip()}") from e
        except subprocess.TimeoutExpired as e:
            raise SyncError(f"git {args[0]} timed out") from e

    if os.path.isdir(f"{folder}/.git"):
        git("fetch", "origin", branch, cwd=folder)
        git("reset", "--hard", f"origin/{branch}", cwd=folder)
        git("clean", "-fdx", cwd=folder)
    else:
        os.makedirs(os.path.dirname(os.path.abspath(folder)), exist_ok=True)
        git("clone", "--branch", branch, url, folder)
    return git("rev-parse", "HEAD", cwd=folder)
