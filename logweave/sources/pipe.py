"""Lines from a socket or a named pipe as a stream, each once across restarts.

A line that comes in is first appended to a spool, a folder beside the checkpoint, and numbered; batches
are stretches of numbers. A batch that runs again is read from the spool, and what a query has
committed leaves it. Not more than ``buffer`` lines lie there: then nothing is read, and the sender waits. Register
with ``spark.dataSource.register(LineFeed)``. The spool is the driver's: for rates that one
process can read, as with any pipe.
"""

from __future__ import annotations

import os
import socket
import threading
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Lines of a spool's file.
SEGMENT = 1000


class LineFeed(DataSource):
    """Options: path (a named pipe) or host and port, spool, maxLines of a batch (1000), buffer (10000)."""

    @classmethod
    def name(cls) -> str:
        return "logweave-lines"

    def schema(self) -> str:
        return "line string, number long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedReader(self.options)


class Spool:
    """Numbered lines in files of ``SEGMENT``, each named by its first number."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(self.folder, exist_ok=True)
        self.lines: dict[int, bytes] = {}
        self.next, self.file, self.acknowledged = 0, None, 0
        for first in sorted(int(n) for n in os.listdir(self.folder) if n.isdigit()):
            with open(f"{self.folder}/{first}", "rb") as f:
                held = f.read()
            whole = held[: held.rfind(b"\n") + 1]
            if len(whole) < len(held):  # the writer died within a line, which its sender will send again or not
                os.truncate(f"{self.folder}/{first}", len(whole))
            for i, line in enumerate(whole.split(b"\n")[:-1]):
                self.lines[first + i] = line
            self.next = first + whole.count(b"\n")
        if os.path.exists(f"{self.folder}/acknowledged"):
            with open(f"{self.folder}/acknowledged") as f:
                self.acknowledge(int(f.read() or 0))
        self.next = max(self.next, self.acknowledged)

    def append(self, line: bytes) -> None:
        if self.file is None or self.next % SEGMENT == 0:
            if self.file:
                self.file.close()
            self.file = open(f"{self.folder}/{self.next}", "ab")
        self.file.write(line + b"\n")
        self.file.flush()
        self.lines[self.next] = line
        self.next += 1

    def acknowledge(self, upto: int) -> None:
        """Lines before a number are done with; files of such lines only go."""
        self.acknowledged = max(self.acknowledged, upto)
        with open(f"{self.folder}/acknowledged.new", "w") as f:
            f.write(str(self.acknowledged))
        os.replace(f"{self.folder}/acknowledged.new", f"{self.folder}/acknowledged")
        for n in [n for n in self.lines if n < self.acknowledged]:
            del self.lines[n]
        firsts = sorted(int(n) for n in os.listdir(self.folder) if n.isdigit())
        for first, after in zip(firsts, firsts[1:]):
            if after <= self.acknowledged:
                os.remove(f"{self.folder}/{first}")


def spooled(folder: str, start: int, stop: int) -> Iterator[tuple]:
    """Lines of a spool by their numbers, from its files."""
    for first in sorted(int(n) for n in os.listdir(folder) if n.isdigit()):
        if start - SEGMENT < first < stop:
            with open(f"{folder}/{first}", "rb") as f:
                for number, line in enumerate(f, first):
                    if start <= number < stop:
                        yield line.rstrip(b"\n").decode("utf-8", "replace"), number


class FeedReader(SimpleDataSourceStreamReader):
    """The spool and the thread that fills it stay on the driver; a copy that travels to a task reads the spool's files."""

    def __init__(self, options):
        self.path, self.host, self.port = options.get("path"), options.get("host", "localhost"), options.get("port")
        if not self.path and not self.port:
            raise ValueError("a path or a port is needed")
        self.most, self.bound = int(options.get("maxLines", "1000")), int(options.get("buffer", "10000"))
        self.spool, self.room = Spool(options["spool"]), threading.Condition()
        self.folder, self.closed = self.spool.folder, False
        self.thread: threading.Thread | None = None

    def _open(self):
        if self.path:
            return open(self.path, "rb")  # waits for a writer
        return socket.create_connection((self.host, int(self.port))).makefile("rb")

    def _follow(self) -> None:
        while not self.closed:
            try:
                with self._open() as f:
                    for line in f:
                        with self.room:
                            while len(self.spool.lines) >= self.bound and not self.closed:
                                self.room.wait(0.1)
                            if self.closed:
                                return
                            self.spool.append(line.rstrip(b"\r\n"))
            except OSError:
                pass
            threading.Event().wait(0.1)  # a sender that went may come again

    def _start(self) -> None:
        if self.thread is None:
            self.thread = threading.Thread(target=self._follow, daemon=True)
            self.thread.start()

    def initialOffset(self) -> dict:
        return {"at": self.spool.acknowledged}

    def _rows(self, start: int, stop: int) -> list[tuple]:
        return [(self.spool.lines[n].decode("utf-8", "replace"), n) for n in range(start, stop) if n in self.spool.lines]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._start()
        with self.room:
            stop = max(start["at"], min(self.spool.next, start["at"] + self.most))
            return iter(self._rows(start["at"], stop)), {"at": stop}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return spooled(self.folder, start["at"], end["at"])

    def __getstate__(self) -> dict:
        return {"folder": self.folder}

    def commit(self, end: dict) -> None:
        with self.room:
            self.spool.acknowledge(end["at"])
            self.room.notify_all()
