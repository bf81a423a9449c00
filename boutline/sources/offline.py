"""Connectors without a network: a Python data source over folders of saved responses, and what is read from these.

A saved response is one file: a page, an API's JSON, or a CSV export. The source gives a row per file with its name, time and
text, checked as a live refresh would be: too small a body, or an HTML error page where a table is due, is refused, and the row
says why. A live connector would differ in the reader alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "name string, bytes long, refused string, body string"


class Saved(InputPartition):
    """Some of the files."""

    def __init__(self, places: list[str]) -> None:
        self.places = places


class SavedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.least, self.expect = options["path"], int(options.get("leastBytes", "0")), options.get("expect", "any")
        self.tasks = int(options.get("tasks", "4"))

    def partitions(self) -> list[Saved]:
        """The files dealt to ``tasks`` partitions; only names pass through the driver."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri)
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Saved(part) for k in range(self.tasks) if (part := names[k :: self.tasks])]

    def read(self, partition: Saved) -> Iterator[pa.RecordBatch]:
        """A batch for each file, so that a task holds one body at a time."""
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.uri)
        for place in partition.places:
            with system.open_input_file(place) as file:
                raw = file.read()
            body = raw.decode("utf-8", "replace")
            why = "too small" if len(raw) < self.least else "a page, not a table" if self.expect == "csv" and body.lstrip()[:1] == "<" else None
            row = (place.rpartition("/")[2], len(raw), why, None if why else body)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["name", "bytes", "refused", "body"])


class SavedResponses(DataSource):
    """``spark.read.format("saved").option("path", folder).load()``"""

    @classmethod
    def name(cls) -> str:
        return "saved"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SavedReader:
        return SavedReader(self.options)


def saved(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The saved responses of a folder, each a row."""
    spark.dataSource.register(SavedResponses)
    return spark.read.format("saved").option("path", folder).options(**options).load()


_EVENTS = "array<struct<home_team:string,away_team:string,commence_time:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>>>"


def odds_events(body: Column) -> Column:
    """``(a, b, starts, book, p)`` of the winner markets of an odds API's response: per book, without the margin."""
    rows = F.from_json(body, _EVENTS)

    def of_event(e: Column) -> Column:
        def of_book(k: Column) -> Column:
            market = F.get(F.filter(k["markets"], lambda m: m["key"] == "h2h"), F.lit(0))
            price = lambda who: F.get(F.filter(market["outcomes"], lambda o: o["name"] == who), F.lit(0))["price"]
            p, q = 1 / price(e["home_team"]), 1 / price(e["away_team"])
            return F.struct(e["home_team"].alias("a"), e["away_team"].alias("b"), F.try_to_timestamp(e["commence_time"], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("starts"), k["key"].alias("book"), (p / (p + q)).alias("p"))

        return F.transform(e["bookmakers"], of_book)

    return F.filter(F.flatten(F.transform(rows, of_event)), lambda x: x["p"].isNotNull())


def wiki_text(body: Column) -> Column:
    """``(title, text)`` from a wiki API's response: the revision's text, or the parsed page's; null where it has neither."""
    revision = F.from_json(body, "query struct<pages:map<string,struct<title:string,revisions:array<struct<slots:map<string,struct<content:string>>>>>>>")
    page = F.get(F.map_values(revision["query"]["pages"]), F.lit(0))
    parsed = F.from_json(body, "parse struct<title:string,wikitext:string>")["parse"]
    content = F.get(F.map_values(F.get(page["revisions"], F.lit(0))["slots"]), F.lit(0))["content"]
    return F.struct(F.coalesce(page["title"], parsed["title"]).alias("title"), F.coalesce(content, parsed["wikitext"]).alias("text"))
