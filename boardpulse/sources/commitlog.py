"""A log of which stored parts count: numbered entries, each put in place by one rename.

An entry holds the whole list of live parts, so a reader opens one small file and then only
the parts named there; folders are never listed for data. A change is computed from the
newest entry and tried as the next number; if another writer took that number first, the
change is computed again from that writer's entry. A part that was written but never entered,
by a writer that died, is invisible.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_log"
# Entries that stay behind the newest one for readers that are just opening them.
KEPT_ENTRIES = 20
MOST_TRIES = 50


@dataclass(frozen=True)
class Part:
    """A folder of data files below the root, with what readers need to skip it.

    ``low`` and ``high`` bound its days (ISO dates) or any other text key; ``level`` is 0 for
    a part as it arrived and one more for each compaction it came out of.
    """

    path: str
    low: str | None = None
    high: str | None = None
    level: int = 0
    more: dict = field(default_factory=dict)

    def touches(self, low: str | None, high: str | None) -> bool:
        """Whether the part may hold keys between the inclusive bounds; open bounds are None."""
        if self.low is None or self.high is None:
            return True
        return (high is None or self.low <= high) and (low is None or self.high >= low)


@dataclass(frozen=True)
class Entry:
    number: int = 0
    parts: tuple[Part, ...] = ()
    # The last batch taken in from each writer; a batch that is repeated counts once.
    taken: dict[str, int] = field(default_factory=dict)

    def with_parts(self, added: tuple[Part, ...] = (), retired: tuple[Part, ...] = ()) -> Entry:
        gone = {part.path for part in retired}
        return replace(self, parts=tuple(p for p in self.parts if p.path not in gone) + tuple(added))


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(FOLDER).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._java.Path(os.path.join(self.root, name))

    def folder(self, part: Part) -> str:
        return os.path.join(self.root, part.path)

    def folders(self, below: str) -> list[str]:
        """Names of the folders in a folder of the root, for its writer to describe."""
        found = [status for status in self._files.listStatus(self._path(below)) if status.isDirectory()]
        names = sorted(status.getPath().getName() for status in found)
        return [name for name in names if not name.startswith(("_", ".")) or "=" in name]

    def _numbers(self) -> list[int]:
        folder = self._path(FOLDER)
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def newest(self) -> Entry:
        """The entry that counts now; an empty one before the first commit."""
        for _ in range(MOST_TRIES):
            numbers = self._numbers()
            if not numbers:
                return Entry()
            try:
                return self._read(numbers[-1])
            except Py4JJavaError as error:
                # Cleared away between listing and opening: a newer one exists.
                if "FileNotFound" not in str(error.java_exception):
                    raise
        raise RuntimeError(f"no entry of {self.root} stays long enough to be read")

    def _read(self, number: int) -> Entry:
        stream = self._files.open(self._path(f"{FOLDER}/{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        plain = json.loads(text)
        return Entry(number, tuple(Part(**part) for part in plain["parts"]), plain["taken"])

    def commit(self, change: Callable[[Entry], Entry | None]) -> Entry:
        """Enter what ``change`` makes of the newest entry; None means there is nothing to enter."""
        for _ in range(MOST_TRIES):
            now = self.newest()
            wanted = change(now)
            if wanted is None:
                return now
            wanted = replace(wanted, number=now.number + 1)
            if self._place(wanted):
                self._clear(wanted.number)
                return wanted
        raise RuntimeError(f"other writers of {self.root} were always faster")

    def _place(self, entry: Entry) -> bool:
        plain = {"parts": [vars(part) for part in entry.parts], "taken": entry.taken}
        draft = self._path(f"{FOLDER}/.{uuid.uuid4().hex}.draft")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(plain).encode()))
        finally:
            stream.close()
        target = self._path(f"{FOLDER}/{entry.number:020d}.json")
        renaming = self.spark.sparkContext._gateway.new_array(self._java.Options.Rename, 0)
        try:
            self._java.FileContext.getFileContext(draft.toUri(), self._conf).rename(
                self._files.makeQualified(draft), self._files.makeQualified(target), renaming
            )
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def _clear(self, number: int) -> None:
        for old in self._numbers():
            if old <= number - KEPT_ENTRIES:
                self._files.delete(self._path(f"{FOLDER}/{old:020d}.json"), False)

    def vacuum(self, below: str = "") -> list[str]:
        """Remove part folders in which the newest entry names nothing; for when no reader uses older entries.

        ``below`` is the folder that holds the parts. Parts being written are not named yet, so
        writers have to rest meanwhile.
        """
        named = {"/".join(part.path.split("/")[: below.count("/") + 2 if below else 1]) for part in self.newest().parts}
        folder, gone = self._path(below) if below else self._java.Path(self.root), []
        if not self._files.exists(folder):
            return gone
        for status in self._files.listStatus(folder):
            name = os.path.join(below, status.getPath().getName())
            if status.isDirectory() and not status.getPath().getName().startswith(("_", ".")) and name not in named:
                self._files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
