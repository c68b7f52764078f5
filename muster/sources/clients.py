"""Transports. Connectors take any object with the same method, so they can be tested on canned responses."""

from __future__ import annotations

import re
import sys
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from types import FunctionType

import pyarrow.fs
from pyspark import cloudpickle


@dataclass(frozen=True)
class Response:
    status: int
    body: str


def send(method: str, url: str, headers: dict[str, str], body: bytes | None = None, timeout: float = 60) -> Response:
    """One request; HTTP errors are responses, failures of the transport raise OSError."""
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Response(r.status, r.read().decode("utf-8", "replace"))
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read().decode("utf-8", "replace"))


@dataclass(frozen=True)
class Retry:
    """attempts in all, with a pause that doubles each time, on these statuses and, if so set, on transport failures."""

    attempts: int = 4
    pause_ms: int = 500
    statuses: Callable[[int], bool] = field(default=lambda s: s == 429 or s >= 500)
    transport: bool = True
    sleep: Callable[[float], None] = time.sleep

    def run(self, call: Callable[[], Response]) -> Response:
        for k in range(self.attempts):
            last = k == self.attempts - 1
            try:
                r = call()
                if last or not self.statuses(r.status):
                    return r
            except OSError:
                if last or not self.transport:
                    raise
            self.sleep(self.pause_ms * 2**k / 1000)
        raise AssertionError("unreachable")


def by_value(client: object) -> object:
    """The client, so that tasks get its class with it: a class of a script or test is in no module that workers can import."""
    module = sys.modules.get(client.__module__ if isinstance(client, FunctionType) else type(client).__module__)
    if module is not None and module.__name__ not in ("__main__", "builtins") and module.__name__.partition(".")[0] != __package__.partition(".")[0]:
        cloudpickle.register_pickle_by_value(module)
    return client


@dataclass(frozen=True)
class RestClient:
    retry: Retry = Retry()

    def get(self, url: str, headers: dict[str, str], query: dict[str, str]) -> Response:
        full = f"{url}?{urllib.parse.urlencode(query)}" if query else url
        return self.retry.run(lambda: send("GET", full, headers))


@dataclass(frozen=True)
class SoapClient:
    def post(self, url: str, envelope: str) -> Response:
        return send("POST", url, {"Content-Type": "text/xml; charset=utf-8"}, envelope.encode())


@dataclass(frozen=True)
class PagesOf:
    """A client that answers from a folder of pages that Spark has written (``partitionBy("page").text``), to replay what a
    service has said."""

    folder: str

    def page(self, number: int) -> Response:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/page={number}")
        files = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        bodies = [fs.open_input_file(f.path).read().decode() for f in files if f.base_name.startswith("part-")]
        return Response(200, "".join(bodies).rstrip("\n")) if bodies else Response(404, f"no page {number}")

    def post(self, url: str, envelope: str) -> Response:
        return self.page(int(re.search(r"<bsvc:Page>(\d+)<", envelope)[1]))

    def get(self, url: str, headers: dict[str, str], query: dict[str, str]) -> Response:
        return self.page(int(query["page"]))


@dataclass(frozen=True)
class PostsTo:
    """A transport that puts each request's body into a folder, under its key: one that comes again replaces the first."""

    folder: str

    def __call__(self, method: str, url: str, headers: dict[str, str], body: bytes) -> Response:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(base)
        with fs.open_output_stream(f"{base}/{headers['Idempotency-Key']}.json") as f:
            f.write(body)
        return Response(200, "")
