"""Files that land in a folder, as a stream that sees a file again when it changes.

Spark's file source lists every path once, so a corrected file of the same name would never be read. This source's
offset is what the folder holds: name, length and time of every weekly file. A batch is what differs from the offset before."""

import re

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pursuit.sources.games import _file_system
from pursuit.sources.tracking import WEEK_FILE

COLUMNS = "season int, week int, kind string, path string, length long, version string"


def listing(path: str) -> dict[str, list]:
    """``{name: [length, time in nanoseconds]}`` of the weekly files, single files or folders of parts, under a folder.

    A file whose name has no season and week is refused; hidden ones and files that are being written (a leading dot
    or underscore) are passed over."""
    from pyarrow import fs

    files, root = _file_system(path)
    found = {}
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name = info.base_name
        if name.startswith((".", "_")):
            continue
        if not re.fullmatch(WEEK_FILE, name):
            raise ValueError(f"no season and week in the file name {name}")
        parts = [info] if info.is_file else [p for p in files.get_file_info(fs.FileSelector(info.path, recursive=True))
                                             if p.is_file and not p.base_name.startswith((".", "_"))]
        if info.is_file or any(p.base_name == "_SUCCESS" for p in files.get_file_info(fs.FileSelector(info.path))):
            found[name] = [sum(p.size for p in parts), max((p.mtime_ns or 0 for p in parts), default=0)]
    return found


class LandingReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def _rows(self, before: dict, after: dict):
        for name, (length, time) in sorted(after.items()):
            if before.get(name) != [length, time]:
                kind = name.split("_")[0]
                season, week = re.fullmatch(WEEK_FILE, name).groups()
                yield int(season), int(week), kind, f"{self.path}/{name}", length, f"{length}-{time}"

    def read(self, start: dict):
        now = listing(self.path)
        return iter(list(self._rows(start, now))), now

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(list(self._rows(start, end)))

    def commit(self, end: dict) -> None:
        pass


class Landing(DataSource):
    """``spark.readStream.format("landing").load(folder)``: one row for every weekly file that is new or has changed."""

    @classmethod
    def name(cls):
        return "landing"

    def schema(self):
        return COLUMNS

    def simpleStreamReader(self, schema):
        return LandingReader(self.options["path"])
