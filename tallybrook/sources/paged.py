"""Pages of reviews as collectors land them, and as a source that a stream resumes.

Layout: root/<app>/page_000001.jsonl, a review a line, and root/<app>/checkpoint.json with the next page, the reviews
so far and whether the store has no more. A page is written before the checkpoint that counts it, each under another name
first, so whoever reads by checkpoints sees whole pages only, and a run that died in between writes the page again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from posixpath import basename, join
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: `place`: the row's place on its page, null for a page without rows; `more`: whether the store has a page after this one.
PAGES = "app_id string, page long, place long, review_id string, review string, more boolean"


def _at(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def _write(files: fs.FileSystem, path: str, text: str) -> None:
    """All of it under its name, or nothing."""
    with files.open_output_stream(path + ".tmp") as out:
        out.write(text.encode())
    files.move(path + ".tmp", path)


def _read(files: fs.FileSystem, path: str) -> str:
    with files.open_input_stream(path) as held:
        return held.read().decode()


def _page(root: str, app: str, page: int) -> str:
    return join(root, quote(app, safe=""), f"page_{page:06d}.jsonl")


def checkpoints(root: str) -> dict[str, dict]:
    """What has been landed of each app: next_page, reviews_collected, complete."""
    files, at = _at(root)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    out = {}
    for folder in (x for x in found if x.type == fs.FileType.Directory):
        path = join(folder.path, "checkpoint.json")
        if files.get_file_info(path).type == fs.FileType.File:
            out[unquote(basename(folder.path))] = json.loads(_read(files, path))
    return out


def land_pages(rows: DataFrame, root: str) -> DataFrame:
    """Writes pages (app_id, page from 1, place, review: a JSON line, more), then the checkpoints that count them; returns those.

    Pages that are there already are written anew, with the same rows if the input has them. A page is of bounded size, and its
    rows are the only ones that meet. Null places: a page without rows.
    """

    def pages(batches):
        files, at = _at(root)
        held: dict[tuple[str, int], list] = {}
        for frame in batches:
            for r in frame.itertuples(index=False):
                if held and (r.app_id, r.page) not in held:
                    yield flush(files, at, held)
                    held = {}
                held.setdefault((r.app_id, r.page), []).append(r)
        if held:
            yield flush(files, at, held)

    def flush(files, at, held) -> pd.DataFrame:
        ((app, page), own) = next(iter(held.items()))
        lines = [r.review for r in own if r.review is not None]
        files.create_dir(join(at, quote(app, safe="")), recursive=True)
        _write(files, _page(at, app, page), "".join(x + "\n" for x in lines))
        return pd.DataFrame({"app_id": [app], "page": [page], "n": [len(lines)], "more": [bool(own[0].more)]})

    spark = rows.sparkSession
    dealt = rows.select("app_id", F.col("page").cast("long").alias("page"), "place", "review", "more").repartition("app_id", "page").sortWithinPartitions("app_id", "page", "place")
    written = dealt.mapInPandas(pages, "app_id string, page long, n long, more boolean")
    last = F.max_by("more", "page")
    progress = written.groupBy("app_id").agg((F.max("page") + 1).alias("next_page"), F.sum("n").alias("reviews_collected"), (~last).alias("complete"))

    def marks(batches):
        files, at = _at(root)
        for frame in batches:
            for r in frame.itertuples(index=False):
                mark = {"app_id": r.app_id, "next_page": int(r.next_page), "reviews_collected": int(r.reviews_collected), "complete": bool(r.complete)}
                _write(files, join(at, quote(r.app_id, safe=""), "checkpoint.json"), json.dumps(mark) + "\n")
            yield frame

    # An app's row exists once all of its pages are written: the exchange before it ends only then.
    return spark.createDataFrame(progress.mapInPandas(marks, progress.schema).toPandas(), progress.schema)


class _Pages(InputPartition):
    def __init__(self, app: str, first: int, after: int, next_page: int, complete: bool):
        super().__init__((app, first, after))
        self.app, self.first, self.after, self.next_page, self.complete = app, first, after, next_page, complete


class LandedPages(DataSource):
    """`landed_pages`: options path, max_pages (of an app; all of them unless told) and app (one app only)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reading:
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("max_pages", 1 << 40))
        self.only = options.get("app")

    def landed(self) -> dict[str, dict]:
        return {a: c for a, c in checkpoints(self.root).items() if self.only in (None, a)}

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[_Pages]:
        """A task for each 16 pages of an app."""
        landed = self.landed()
        out = []
        for app, after in sorted(end.items()):
            for first in range(start.get(app, 1), after, 16):
                out.append(_Pages(app, first, min(first + 16, after), landed[app]["next_page"], landed[app]["complete"]))
        return out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        files, at = _at(self.root)
        for page in range(partition.first, partition.after):
            lines = [x for x in _read(files, _page(at, partition.app, page)).split("\n") if x.strip()]
            more = page + 1 < partition.next_page or not partition.complete
            if not lines:
                yield partition.app, page, None, None, None, more
            for place, line in enumerate(lines):
                ident = json.loads(line).get("review_id")
                yield partition.app, page, place, None if ident is None else str(ident), line, more


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[_Pages]:
        return self.parts({}, {a: min(c["next_page"], self.most + 1) for a, c in self.landed().items()}) or [_Pages("", 1, 1, 1, True)]


class _StreamReader(_Reading, DataSourceStreamReader):
    """The offset holds, for each app, the page that its walk goes on with: the continuation token of landed pages.

    Spark logs a batch's end offset before it runs, and commits it after the sink has; so a run that was killed in between
    reads the same pages again.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {a: min(c["next_page"], self.most + 1) for a, c in self.landed().items()}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        return self.parts(start, end)


def read_pages(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").options(path=root, **options).load()


def stream_pages(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").options(path=root, **options).load()
