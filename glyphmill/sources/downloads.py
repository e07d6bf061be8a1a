"""Images over HTTP: pooled connections, retries, a timeout, and a check of what was written."""

from __future__ import annotations

import http.client
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one folder.
BLOCK = 10_000


class HttpFetcher:
    """Bodies of URLs; each thread keeps one connection for each host. Statuses other than 200 are errors."""

    def __init__(self, timeout: float = 10.0, headers: dict[str, str] | None = None):
        self.timeout, self.headers, self.held = timeout, headers or {}, threading.local()

    def __getstate__(self) -> dict:
        return {"timeout": self.timeout, "headers": self.headers}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def __call__(self, url: str) -> bytes:
        parts = urlsplit(url)
        pool = self.held.__dict__.setdefault("pool", {})
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        key = (parts.scheme, parts.netloc)
        connection = pool.get(key) or pool.setdefault(key, kind(parts.netloc, timeout=self.timeout))
        try:
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=self.headers)
            response = connection.getresponse()
            body = response.read()
        except Exception:
            pool.pop(key).close()  # a later try opens a new one
            raise
        if response.status != 200:
            raise ValueError(f"status {response.status}")
        return body


def downloaded(rows: DataFrame, folder: str, fetch: Callable[[str], bytes], verify: Callable[[bytes], bool], threads: int = 8, tries: int = 3, suffix: str = ".jpg") -> DataFrame:
    """id, path, state of rows (position, id, url): files <position div BLOCK>/<id><suffix> in a folder that executors share.

    States: skipped (no id), there (a valid file is there already), written, failed and invalid with a reason. A file is
    written under another name, read back, checked, and then renamed; one that fails the check does not stay.
    """

    def one(position: int, name: str | None, url: str | None) -> tuple[str | None, str, str | None]:
        name = (name or "").strip()
        if not name:
            return None, "skipped", None
        target = Path(folder, str(position // BLOCK), f"{name}{suffix}")
        if target.exists() and _valid(target, verify):
            return str(target), "there", None
        reason = "no url"
        for _ in range(tries if url else 0):
            try:
                data = fetch(url)
                break
            except Exception as e:  # noqa: BLE001  a fetcher may fail in any way; the reason is the result
                reason = f"{type(e).__name__}: {e}"
        else:
            return None, "failed", reason
        target.parent.mkdir(parents=True, exist_ok=True)
        temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        temporary.write_bytes(data)
        if not _valid(temporary, verify):
            temporary.unlink()
            return None, "invalid", "the written file can't be read"
        os.replace(temporary, target)
        return str(target), "written", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf["position"], pdf["id"], pdf["url"]))
                yield pd.DataFrame({"id": pdf["id"], "path": [g[0] for g in got], "state": [g[1] for g in got], "reason": [g[2] for g in got]})

    return rows.select(F.col("position").cast("long"), F.col("id").cast("string"), "url").mapInPandas(run, "id string, path string, state string, reason string")


def _valid(path: Path, verify: Callable[[bytes], bool]) -> bool:
    try:
        return bool(verify(path.read_bytes()))
    except Exception:  # noqa: BLE001  a check that fails in any way is a file that can't be read
        return False
