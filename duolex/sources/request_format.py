"""Requests as a Spark data source: JSON lines read by byte ranges with strict fields, results written with a commit step.

    spark.dataSource.register(RequestFormat)
    spark.read.format("alignment_requests").load(path)
    responses.write.format("alignment_requests").mode("append").save(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..options import SHARES, SPANS, STRATEGIES, Repair
from .pairs import PAIR_FIELDS, PAIRS, REPAIR_SCHEMA, REQUEST_FIELDS

SCHEMA = f"""pair_id string, request_id string, idx int, source_language string, target_language string, source string, target string, method string, id string,
    repair {REPAIR_SCHEMA}, request_errors array<string>"""
#: Bytes that one task reads, and that it asks for at once.
SPLIT, CHUNK = 32 << 20, 1 << 20


def _files(path: str):
    """A file system and the path in it: local paths, and all that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def lines_between(read, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [begin, end); `read(at, n)` gives bytes. A line belongs to the range in which it begins, however far it goes."""
    at, held = max(0, begin - 1), b""
    skip = begin > 0  # the line that the byte before belongs to
    while True:
        new = read(at + len(held), CHUNK)
        data = held + new
        parts = data.split(b"\n")
        for line in parts[:-1]:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line
            at += len(line) + 1
        held = parts[-1]
        if not new:
            if held and not skip and at < end:
                yield at, held
            return
        if at >= end:
            return


def _typed(value, kind: type | tuple):
    return value if isinstance(value, kind) and not isinstance(value, bool) else None


def repair_of(given) -> tuple[dict | None, bool]:
    """The options of a repair by name (none for those not given or of another type), and whether they hold."""
    if given is None:
        return None, True
    if not isinstance(given, dict):
        return None, False
    kinds = {"enabled": bool, "strategy": str} | {c: (int, float) for c in SHARES} | {c: int for c in SPANS}
    right = {c: isinstance(given.get(c), k) and (k is bool or not isinstance(given[c], bool)) for c, k in kinds.items()}
    ok = all(given.get(c) is None or right[c] for c in kinds)
    ok = ok and all(given.get(c) is None or rule(given[c]) for c, rule in {"strategy": STRATEGIES.__contains__, **{c: lambda x: 0 <= x <= 1 for c in SHARES}, **{c: lambda x: 1 <= x <= 32 for c in SPANS}}.items())
    return {c: (float(given[c]) if c in SHARES else given[c]) if right[c] else None for c in kinds}, ok


def rows_of(line: bytes, request_id: str) -> Iterator[tuple]:
    """One row per pair of a request; one that breaks a rule as a whole says so in each, and has a row though it has no pairs."""
    try:
        request = json.loads(line)
    except ValueError:
        request = None
    if not isinstance(request, dict):
        yield (f"{request_id}:", request_id, None, None, None, None, None, "itermax", None, None, ["json", "sentence_pairs"])
        return
    pairs = request.get("sentence_pairs")
    pairs = pairs if isinstance(pairs, list) and all(isinstance(p, dict) for p in pairs) else []
    repair, repair_ok = repair_of(request.get("repair"))
    known = set(request) <= set(REQUEST_FIELDS) and all(set(p) <= set(PAIR_FIELDS) for p in pairs) and set(request.get("repair") or {}) <= set(Repair.__dataclass_fields__)
    rules = {"fields": known, "sentence_pairs": PAIRS[0] <= len(pairs) <= PAIRS[1], "repair": repair_ok}
    errors = [name for name, ok in rules.items() if not ok]
    text = lambda x, c: _typed(x.get(c), str)
    head = (text(request, "source_language"), text(request, "target_language"))
    for k, p in enumerate(pairs or [{}]):
        idx = k if pairs else None
        yield (f"{request_id}:{'' if idx is None else idx}", request_id, idx, *head, text(p, "source"), text(p, "target"), text(request, "method") or "itermax", text(p, "id"), repair, errors)


class RequestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, path = _files(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path))
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(file, at, min(size, at + self.split)) for file, size in found for at in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = _files(self.path)
        name = partition.file.rsplit("/", 1)[-1]
        with files.open_input_file(partition.file) as f:
            for at, line in lines_between(lambda where, n: f.read_at(n, where), partition.begin, partition.end):
                if line.strip():
                    yield from rows_of(line, f"{name}:{at}")


@dataclass
class Written(WriterCommitMessage):
    file: str


class ResultWriter(DataSourceWriter):
    """Each task writes a file of its own under a hidden folder of this job; only the commit moves them to where readers look. A failed task or job leaves nothing."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        files, path = _files(self.path)
        folder = f"{path}/_writing-{self.job}"
        files.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.json"
        try:
            with files.open_output_stream(f"{folder}/{name}") as f:
                for r in rows:
                    f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
        except BaseException:
            files.delete_file(f"{folder}/{name}")
            raise
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    files.delete_file(f.path)
        files.create_dir(path, recursive=True)
        for m in messages:
            if m is not None:
                files.move(f"{path}/_writing-{self.job}/{m.file}", f"{path}/{m.file}")
        self._clear(files, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, files, path: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{path}/_writing-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/_writing-{self.job}")


class RequestFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignment_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RequestReader:
        return RequestReader(self.options)

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options, overwrite)
