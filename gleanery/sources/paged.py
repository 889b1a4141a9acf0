"""A paged source: replies with continuation marks, read page by page with retries.

Replies are captured in a folder, which stands in for a network. A partition is a chain of pages from a first one, whose
name ends with -0; chains are read by different tasks. A reply is JSON (items, and in continue the next page's name), and that
of ``<name>.try<k>`` is what the k-th request for a page got instead (a status). A chain's replies lie in a sub-folder
``chain=<name of the first>``, a line of name, tab and JSON each, in any order, or each in a sub-folder ``page=<name>`` of its own.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Replies that may be different the next time.
PASSING = (429, 500, 502, 503, 504)


class PageError(RuntimeError):
    """A page that could not be had."""


def fetched(request: Callable[[str, int], dict], page: str, tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The reply for a page. Passing faults are tried again, after a longer wait each time or as long as the reply asks
    for; any other fault, or the last try's, is an error."""
    status = None
    for k in range(tries):
        reply = request(page, k)
        status = reply.get("status", 200)
        if status < 400:
            return reply
        if status not in PASSING:
            break
        if k + 1 < tries:
            sleep(max(wait * (k + 1), float(reply.get("retry_after", 0) or 0)))
    raise PageError(f"{page}: status {status}")


def chained(request: Callable[[str, int], dict], start: str, tries: int, wait: float, most_pages: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, int, dict]]:
    """page, place and item of all pages from a start on. A mark that leads back to a page is an error, not a loop."""
    page, seen = start, set()
    while page:
        if page in seen or len(seen) >= most_pages:
            raise PageError(f"{start}: its pages do not end ({page})")
        seen.add(page)
        reply = fetched(request, page, tries, wait, sleep)
        for place, item in enumerate(reply.get("items") or []):
            yield page, place, item
        page = reply.get("continue")


class Recorded:
    """The replies of a chain's files by name: only their places are held."""

    def __init__(self, files, folder: str):
        from pyarrow import fs

        self.places = {}
        for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.is_file and not x.base_name.startswith((".", "_")):
                lines, at = io.BufferedReader(files.open_input_file(x.path), 1 << 20), 0
                for line in lines:
                    name = line.partition(b"\t")[0]
                    self.places[name.decode()] = lines, at + len(name) + 1, len(line) - len(name) - 1
                    at += len(line)

    def reply(self, name: str) -> dict:
        if name not in self.places:
            return {"status": 404}
        lines, at, size = self.places[name]
        lines.seek(at)
        return json.loads(lines.read(size))


class Chain(InputPartition):
    def __init__(self, start: str):
        super().__init__(start)
        self.start = start


class CapturedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.prefix = options["path"], options.get("starts", "")
        self.tries, self.wait, self.most_pages = int(options.get("tries", "5")), float(options.get("wait", "0")), int(options.get("mostpages", "100000"))

    def _folder(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def partitions(self):
        from pyarrow import fs

        files, root = self._folder()
        names = [x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
        starts = {x.removeprefix("page=") for x in names if x.startswith("page=") and x.endswith("-0")} | {x.removeprefix("chain=") for x in names if x.startswith("chain=")}
        return [Chain(x) for x in sorted(starts) if x.startswith(self.prefix)]

    def read(self, partition):
        from pyarrow import fs

        files, root = self._folder()
        recorded = Recorded(files, f"{root}/chain={partition.start}")

        def request(page: str, k: int) -> dict:
            if recorded.places:
                name = f"{page}.try{k}"
                return recorded.reply(name if name in recorded.places else page)
            for folder in (f"{root}/page={page}.try{k}", f"{root}/page={page}"):
                info = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                for x in info:
                    if x.is_file and not x.base_name.startswith((".", "_")):
                        with files.open_input_stream(x.path) as f:
                            return json.loads(f.read())
            return {"status": 404}

        for page, place, item in chained(request, partition.start, self.tries, self.wait, self.most_pages):
            yield partition.start, page, place, json.dumps(item, ensure_ascii=False)


class CapturedPages(DataSource):
    """Options: path, starts (what the names of first pages begin with), tries, wait (seconds), mostPages (of a chain)."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "start string, page string, place int, item string"

    def reader(self, schema):
        return CapturedReader(self.options)


def write_chains(replies: DataFrame, path: str) -> None:
    """Captures replies: chain (the name of its first page), page and value (JSON), in a file for each chain."""
    lines = replies.select("chain", F.concat("page", F.lit("\t"), "value").alias("value"))
    lines.repartition("chain").write.partitionBy("chain").text(path)


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """start, page, place and item (as JSON) of all pages of a captured folder."""
    spark.dataSource.register(CapturedPages)
    return spark.read.format("captured_pages").option("path", path).options(**options).load()
