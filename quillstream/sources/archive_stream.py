"""Archives as a Spark streaming source: units read by tasks, cursors as resumable offsets, the transport behind an option.

    spark.dataSource.register(ArchiveSource)
    spark.readStream.format("archive").options(specs=json, state=folder, fetcher="http").load()

A specification is a dict as in sources.archives (name, kind, url, date_format, pagesize, first, method, body, max_units, since for a walk by date)
plus chunk (units of a batch) and links (a pattern whose group 1 finds a page's addresses). The offset of a batch holds, for each archive, the cursor it
reads from and the one it reads to. Archives are read side by side, a partition each, which keeps an archive's units in order: its end is told from what neighbours hold, and a site is
not asked twice at once. A walk by date knows its last day; with the option `days_at_once` its chunk is split into partitions of so many days, and no
page of it ends the walk then.

Rows: archive, unit, cursor (JSON), url, status, raw. Status `page` has content; `failed` is a unit that could not be fetched and is passed
over; the last row of a walk says why it ended: `empty` page, `wrapped` to the first page, `repeated` the page before, or `error` after MAX_FAILURES
failures in a row.

Exactly once. Spark logs a batch's offsets before it plans the batch, and plans a batch again after a failure from those offsets. A Python source is not
told where a stream stood when it restarts, so the plan also notes the cursors in the folder `state` once they are logged; that note never runs ahead
of the log. Tasks note there how a walk ended, under a name that a second attempt only writes again. A walk that ended with `error` goes on from the
failing unit when the stream is started anew; other ends are final.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import importlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "archive string, unit long, cursor string, url string, status string, raw string"
CHUNK, MAX_FAILURES = 20, 3
LINKS = r'"url"\s*:\s*"([^"]+)"'
#: Takes a request (method, url, body) and returns the page; raises OSError where there is none.
Fetch = Callable[[dict], str]


def http(request: dict, timeout: float = 30.0) -> str:
    """GET or POST over the network."""
    from urllib.request import Request, urlopen

    body = request.get("body")
    call = Request(request["url"], data=body.encode() if body is not None else None, method=request.get("method") or "GET", headers={"Content-Type": "application/json"} if body else {})
    with urlopen(call, timeout=timeout) as answer:  # a status of 400 or more is an OSError
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def folder(request: dict) -> str:
    """Recorded pages: the address names a folder of one file, or a file, in any store that pyarrow opens."""
    from pyarrow import fs

    files, path = _open(request["url"])
    if files.get_file_info(path).type == fs.FileType.Directory:
        inside = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")]
        if len(inside) != 1:
            raise OSError(f"{path} holds {len(inside)} files")
        path = inside[0]
    with files.open_input_stream(path) as f:
        return f.read().decode()


FETCHERS: dict[str, Fetch] = {"http": http, "folder": folder}


def fetcher(name: str) -> Fetch:
    """A fetcher by name, or by `module:function` for one of the caller's own."""
    if name in FETCHERS:
        return FETCHERS[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"no fetcher {name!r}; there are {sorted(FETCHERS)}, or module:function")
    return getattr(importlib.import_module(module), function)


def cursor_at(spec: dict, unit: int) -> dict:
    """The cursor that stands before a unit."""
    kind = spec["kind"]
    day = (dt.date.fromisoformat(spec["since"]) + dt.timedelta(days=unit)).isoformat() if kind == "date" else None
    return {"date": day, "page": spec.get("first", 1) + (unit if kind == "page" else 0), "offset": unit * spec.get("pagesize", 0) if kind == "offset" else 0, "units_done": unit}


def request_at(spec: dict, cursor: dict) -> dict:
    day = dt.date.fromisoformat(cursor["date"]).strftime(spec.get("date_format", "%Y-%m-%d")) if cursor["date"] else ""
    marks = {"{date}": day, "{page}": str(cursor["page"]), "{offset}": str(cursor["offset"]), "{pagesize}": str(spec.get("pagesize", ""))}
    url, body = spec["url"], spec.get("body")
    for mark, value in marks.items():
        url, body = url.replace(mark, value), body.replace(mark, value) if body is not None else None
    return {"method": spec.get("method", "GET"), "url": url, "body": body}


def units_of(spec: dict, today: dt.date) -> int:
    """How many units an archive has at most."""
    most = spec.get("max_units", 1 << 40)
    return min(most, max(0, (today - dt.date.fromisoformat(spec["since"])).days + 1)) if spec["kind"] == "date" else most


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class Notes:
    """Small JSON notes in a shared folder, each written whole or not at all."""

    def __init__(self, path: str):
        self.files, self.path = _open(path)

    def read(self, name: str) -> dict | None:
        from pyarrow import fs

        at = f"{self.path}/{name}.json"
        if self.files.get_file_info(at).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(at) as f:
            return json.loads(f.read())

    def write(self, name: str, value: dict) -> None:
        at = f"{self.path}/{name}.json"
        self.files.create_dir(at.rpartition("/")[0], recursive=True)
        own = f"{at}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(own) as f:
            f.write(json.dumps(value).encode())
        self.files.move(own, at)


@dataclass
class Units(InputPartition):
    """Units [start, stop) of an archive."""

    spec: dict
    start: int
    stop: int
    alone: bool  # whether the rules of the archive's end apply


def fingerprint(urls: list[str]) -> str:
    return hashlib.sha1("\n".join(sorted(urls)).encode()).hexdigest() if urls else ""


def read_units(part: Units, fetch: Fetch, notes: Notes | None) -> Iterator[tuple]:
    """The rows of a partition, until its end or the archive's."""
    spec, kind = part.spec, part.spec["kind"]
    links = re.compile(spec.get("links", LINKS))
    known = notes.read(f"first/{_safe(spec['name'])}") if notes and kind == "page" and part.start else None
    first, before, failures = known["fingerprint"] if known else None, "", 0
    if kind == "page" and part.start and first is None:  # the first page is asked again where no note is left
        try:
            first = fingerprint(links.findall(fetch(request_at(spec, cursor_at(spec, 0)))))
        except OSError:
            first = ""

    def ended(unit: int, row: tuple, why: str) -> tuple:
        if notes:
            notes.write(f"ends/{_safe(spec['name'])}", {"from": part.start, "unit": unit, "why": why})
        return (*row, why, None)

    for unit in range(part.start, part.stop):
        cursor = cursor_at(spec, unit)
        request = request_at(spec, cursor)
        row = (spec["name"], unit, json.dumps(cursor), request["url"])
        try:
            raw = fetch(request)
        except OSError:
            failures, before = failures + 1, ""
            if failures >= MAX_FAILURES and part.alone:
                yield ended(unit, row, "error")
                return
            yield (*row, "failed", None)
            continue
        failures, now = 0, fingerprint(links.findall(raw))
        why = "empty" if not now and kind != "date" else "wrapped" if now and kind == "page" and unit and now == first else "repeated" if now and now == before else None
        if why and part.alone:
            yield ended(unit, row, why)
            return
        if kind == "page" and not unit:
            first = now
            if notes:
                notes.write(f"first/{_safe(spec['name'])}", {"fingerprint": now})
        before = now
        yield (*row, "page", raw)


def _safe(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.specs = {s["name"]: s for s in json.loads(options["specs"])}
        self.state, self.name = options["state"], options.get("fetcher", "http")
        self.today = dt.date.fromisoformat(options["today"]) if "today" in options else None
        self.days = int(options.get("days_at_once", 0))
        notes = Notes(self.state)
        #: Walks that had failed before this run began; they go on.
        self.again = {n: end for n in self.specs if (end := notes.read(f"ends/{_safe(n)}")) and end["why"] == "error"}
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def _noted(self) -> dict:
        """The newest offset that Spark has logged, as this run or the note knows it."""
        noted = Notes(self.state).read("offset") or {}
        return max(noted, self.seen, key=lambda o: o.get("batch", 0))

    def latestOffset(self) -> dict:
        notes, last = Notes(self.state), self._noted()
        today, moved = self.today or dt.datetime.now(dt.timezone.utc).date(), False
        archives = dict(last.get("archives", {}))
        for name, spec in self.specs.items():
            at = archives.get(name)
            start = at["to"]["units_done"] if at else 0
            end = notes.read(f"ends/{_safe(name)}")
            if at and end and end["from"] == at["from"]["units_done"]:  # how the last chunk ended
                if self.again.get(name) != end:
                    continue
                start = end["unit"]
            stop = min(start + spec.get("chunk", CHUNK), units_of(spec, today))
            if stop > start:
                archives[name] = {"from": cursor_at(spec, start), "to": cursor_at(spec, stop)}
                moved = True
        return {"batch": last.get("batch", 0) + 1, "archives": archives} if moved else last

    def partitions(self, start: dict, end: dict) -> list[Units]:
        if end.get("batch", 0) > self._noted().get("batch", 0):
            self.seen = end
            Notes(self.state).write("offset", end)
        before, out = start.get("archives", {}), []
        for name, at in end.get("archives", {}).items():
            if at == before.get(name) or name not in self.specs:
                continue
            spec, a, b = self.specs[name], at["from"]["units_done"], at["to"]["units_done"]
            step = self.days if spec["kind"] == "date" and self.days else b - a
            out += [Units(spec, k, min(k + step, b), step == b - a) for k in range(a, b, step)]
        return out

    def read(self, partition: Units) -> Iterator[tuple]:
        return read_units(partition, fetcher(self.name), Notes(self.state))


class ArchiveReader(DataSourceReader):
    """All units of each archive, from the first to its end, without notes."""

    def __init__(self, options: dict):
        self.specs, self.name = json.loads(options["specs"]), options.get("fetcher", "http")
        self.today = options.get("today")

    def partitions(self) -> list[Units]:
        today = dt.date.fromisoformat(self.today) if self.today else dt.datetime.now(dt.timezone.utc).date()
        return [Units(s, 0, units_of(s, today), True) for s in self.specs]

    def read(self, partition: Units) -> Iterator[tuple]:
        return read_units(partition, fetcher(self.name), None)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(dict(self.options))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))
