"""A streaming sink that sends notices, each once.

Tasks send the rows of their partitions by a notifier (see ``notifiers``) and write
each key down, in a ledger that lies beside the checkpoint, as soon as it is sent. A batch that failed half-way and runs
again, however its rows are dealt out then, skips what the ledger of that batch has. Only a notice whose task died between
sending and writing is sent anew, with the key it had; web hooks get it as ``Idempotency-Key``, so that a
receiver that knows keys drops it. Register with ``spark.dataSource.register(NoticeSink)``.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from . import notifiers


@dataclass
class _Sent(WriterCommitMessage):
    sent: int
    skipped: int


class NoticeSink(DataSource):
    """Options: kind, settings (JSON of the notifier's settings), ledger (a folder that driver and executors mount), keep (batches whose ledgers stay, 100).

    Rows have event_id and payload. A row without an event_id is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "logweave-notices"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        missing = {"event_id", "payload"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns {sorted(missing)} are needed")
        return NoticeWriter(self.options)


class NoticeWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.kind, self.settings = options["kind"], json.loads(options.get("settings", "{}"))
        self.ledger = options["ledger"].removeprefix("file://").removeprefix("file:")
        self.keep = int(options.get("keep", "100"))
        notifiers.create(self.kind, **self.settings)  # so that wrong settings are found at once

    def _folder(self, batch) -> str:
        return f"{self.ledger}/batch={int(batch)}"

    def _known(self, batch) -> set[str]:
        known = set()
        folder = self._folder(batch)
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if name.endswith(".keys"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    known.update(line[:-1] for line in f if line.endswith("\n"))
        return known

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        batch = TaskContext.get().getLocalProperty("streaming.sql.batchId")
        if batch is None:
            raise RuntimeError("notices are sent from streaming queries only")
        send, known = notifiers.create(self.kind, **self.settings), self._known(batch)
        os.makedirs(self._folder(batch), exist_ok=True)
        sent = skipped = 0
        with open(f"{self._folder(batch)}/{uuid.uuid4().hex}.keys", "a", encoding="utf-8") as f:
            for row in iterator:
                if row["event_id"] is None:
                    raise ValueError("a notice without an event_id")
                key = f"{batch}-{row['event_id']}"
                if key in known:
                    skipped += 1
                    continue
                send(row.asDict() | {"key": key})
                f.write(key + "\n")
                f.flush()
                os.fsync(f.fileno())
                known.add(key)
                sent += 1
        return _Sent(sent, skipped)

    def commit(self, messages, batchId: int) -> None:
        """Notes the batch as done; ledgers of batches long done go."""
        folder = self._folder(batchId)
        os.makedirs(folder, exist_ok=True)
        done = [m for m in messages if m is not None]
        with open(f"{folder}/done.json", "w", encoding="utf-8") as f:
            json.dump({"sent": sum(m.sent for m in done), "skipped": sum(m.skipped for m in done)}, f)
        for name in os.listdir(self.ledger):
            number = name.removeprefix("batch=")
            if name.startswith("batch=") and number.isdigit() and int(number) <= batchId - self.keep:
                shutil.rmtree(f"{self.ledger}/{name}", ignore_errors=True)

    def abort(self, messages, batchId: int) -> None:
        """What was sent stays written down, for when the batch runs again."""
