"""Following growing files: a streaming source that knows a file by what it is, not by its name.

Spark's file source takes a file as finished once it is seen. This one keeps, for
each file, {inode: path, bytes read, a fingerprint of its beginning}: what was
appended since is the next batch, new files that fit are picked up, and
half-written last lines wait. So a log that is renamed is read to its end under its new name, and
only then the one that was begun in its place; a file that was emptied, or written anew, in its place is
read from its start, even if it has grown past the old place meanwhile. A batch takes at most ``maxLines`` new lines of a
file. A query that is started again goes on from its checkpoint: its first
batch takes what was appended meanwhile, however much. Register with ``spark.dataSource.register(TailSource)``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file's beginning that tell it from another one.
HEAD = 1024


class _Span(InputPartition):
    def __init__(self, key: str, path: str, start: int, stop: int):
        self.key, self.path, self.start, self.stop = key, path, start, stop


class TailSource(DataSource):
    """Options: path, patterns ('*.log,*.jsonl'), recursive, maxLines (100), maxFileMb (none), failOnDataLoss (true).

    ``maxFileMb`` leaves out files that are larger when they are first seen; a file that is followed
    is followed on, whatever it grows to. A file that was planned to be read and is gone since is an error, or, without
    ``failOnDataLoss``, nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "logweave-tail"

    def schema(self) -> str:
        return "line string, source string, position long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def _head(path: str, size: int) -> list:
    """How many bytes of the beginning are known, and their hash."""
    with open(path, "rb") as f:
        start = f.read(min(size, HEAD))
    return [len(start), hashlib.sha256(start).hexdigest()[:16]]


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.patterns = options.get("patterns", "*.log,*.jsonl").split(",")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.lines = int(options.get("maxLines", "100"))
        self.most = float(options.get("maxFileMb", "inf")) * 1024 * 1024
        self.strict = options.get("failOnDataLoss", "true").lower() == "true"
        self.last: dict = {}
        # Only a query without a checkpoint asks for the initial offset; else what was read is known to Spark alone.
        self.fresh = False

    def _fits(self, path: str, rotated: bool = False) -> bool:
        """Whether a file is followed by its name; with ``rotated``, whether it may have been before it got more at the name's end."""
        return path == self.path or any(fnmatch.fnmatch(os.path.basename(path), p + "*" * rotated) for p in self.patterns)

    def _files(self) -> dict[str, tuple[str, int]]:
        """{inode: (path, size)} of files that fit or may once have; files that vanish meanwhile are left out."""
        single = not os.path.isdir(self.path)
        top = os.path.dirname(self.path) or "." if single else self.path
        found = {}
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if single and not (folder == top and name.startswith(os.path.basename(self.path))):
                    continue
                if not (single or self._fits(path, rotated=True)) or not (self.recursive or folder == top):
                    continue
                try:
                    said = os.stat(path)
                except OSError:
                    continue
                found[str(said.st_ino)] = (path, said.st_size)
            if single:
                break
        return found

    @staticmethod
    def _lines_end(path: str, size: int, block: int = 65536) -> int:
        """Where the last whole line of a file ends."""
        with open(path, "rb") as f:
            while size > 0:
                start = max(size - block, 0)
                f.seek(start)
                at = f.read(size - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                size = start
        return 0

    @staticmethod
    def _goes_on(entry: dict, path: str, size: int) -> bool:
        """Whether a file is still the one that was read so far: not shorter, and with the same beginning."""
        return size >= entry["at"] and _head(path, entry["head"][0]) == entry["head"]

    def initialOffset(self) -> dict:
        self.fresh = True
        return {}

    def _entry(self, key: str, path: str, size: int, files: dict) -> dict | None:
        """Up to where a file is read next; None if it isn't followed."""
        known = self.last.get(key) if self.fresh else None
        if not self._fits(path) and self.fresh and known is None:
            return None
        if known is None and size > self.most:
            return None
        name = known["as"] if known else path
        start = known["at"] if known and self._goes_on(known, path, size) else 0
        entry = {"path": path, "as": name, "at": start, "head": _head(path, size)}
        # A file with a successor is no longer written to: its half-written last line is a line.
        ended = path != name and any(p == name and n > 0 for k, (p, n) in files.items() if k != key)
        if not self.fresh:
            entry["at"] = self._lines_end(path, size)
            return entry
        if known is None and any(k != key and e["as"] == path and k in files and files[k][0] != path and e["at"] < files[k][1] for k, e in self.last.items()):
            return None  # its predecessor comes first
        with open(path, "rb") as f:
            f.seek(start)
            for _ in range(self.lines):
                line = f.readline()
                if not line.endswith(b"\n") and not (ended and line):
                    break
                entry["at"] += len(line)
        return entry

    def latestOffset(self) -> dict:
        files, out = self._files(), {}
        for key, (path, size) in files.items():
            try:
                entry = self._entry(key, path, size, files)
            except OSError:  # it went meanwhile; under another name it is found again
                entry = self.last.get(key)
            if entry is not None:
                out[key] = entry
        self.last, self.fresh = dict(out), True
        return out

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        spans = []
        for key, entry in end.items():
            known = start.get(key)
            if known is None and not self._fits(entry["path"]):
                continue  # it was never followed
            begin = 0
            if known is not None and known["at"] <= entry["at"]:
                try:
                    same = entry["head"][0] >= known["head"][0] and _head(self._now(key, entry["path"]), known["head"][0]) == known["head"]
                except OSError:
                    same = True  # whether that is an error is found when it is read
                begin = known["at"] if same else 0
            if entry["at"] > begin:
                spans.append(_Span(key, entry["path"], begin, entry["at"]))
        return spans

    def _now(self, key: str, path: str) -> str:
        """Where a file is, if it was renamed since it was seen; an OSError if it is gone."""
        try:
            if str(os.stat(path).st_ino) == key:
                return path
        except OSError:
            pass
        found = self._files().get(key)
        if found is None:
            raise FileNotFoundError(f"{path} is gone before it was read")
        return found[0]

    def read(self, span: _Span) -> Iterator[tuple]:
        try:
            f = open(self._now(span.key, span.path), "rb")
        except OSError:
            if self.strict:
                raise
            return
        with f:
            f.seek(span.start)
            at = span.start
            while at < span.stop:
                raw = f.readline()
                if not raw:
                    break
                line = raw.decode("utf-8", "replace").rstrip("\r\n")
                if line:
                    yield line, span.path, at
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass
