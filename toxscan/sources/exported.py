"""S1 as a data source: ``spark.read.format("posts")`` over a folder of exported posts.

A document store exports a collection as files with one JSON document a line. Files are cut into byte ranges, one input partition each; a
range holds the lines that begin in it. Each range is parsed by Arrow, with the wanted fields only, and filters on ``label`` and
``labeling_confirm`` are taken by the source, so dropped posts never reach Spark.

Options: ``path``; ``range_bytes``, the length of a range; ``id``, ``long`` (a number) or ``oid`` (the store's own id, as ``{"$oid": ..}``; ``doc_id``
is a string then). A line that is no document, or a value of the wrong type, is an error. Empty lines are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
)

from toxscan.session import ship_package

RANGE_BYTES = 128 << 20
#: Bytes parsed at once.
BLOCK_BYTES = 8 << 20
FILTERED = ("label", "labeling_confirm")


class Range(InputPartition):
    """The lines of ``file`` that begin at ``start`` or later and before ``end``."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _supported(f: Filter) -> bool:
    if isinstance(f, Not):
        return _supported(f.child)
    return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull, IsNull)) and f.attribute in [(c,) for c in FILTERED]


def _passes(f: Filter, table):
    """Which rows of an Arrow table a filter lets through; null where it is null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(f, Not):
        return pc.invert(_passes(f.child, table))
    column = table.column(f.attribute[0])
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, In):
        found = pc.is_in(column, pa.array(f.value, column.type))
        return pc.if_else(pc.is_valid(column), found, None)
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less,
               LessThanOrEqual: pc.less_equal}[type(f)]
    return compare(column, pa.scalar(f.value, column.type))


class PostsReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, oid: bool):
        self.path, self.range_bytes, self.oid = path, range_bytes, oid
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _supported(f):
                self.filters.append(f)
            else:
                yield f

    def _open(self):
        from pyarrow import fs

        path = self.path.removeprefix("file:") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = self._open()
        told = system.get_file_info(path)
        files = [told] if told.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        wanted = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(name, start, min(start + self.range_bytes, size)) for name, size in wanted for start in range(0, size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator:
        if partition is None:  # a folder without files
            return
        import io

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import json

        id_type = pa.struct([("$oid", pa.string())]) if self.oid else pa.int64()
        fields = pa.schema([("_id", id_type), ("string", pa.string()), ("label", pa.int32()), ("labeling_confirm", pa.int32())])
        parse = json.ParseOptions(explicit_schema=fields, unexpected_field_behavior="ignore", newlines_in_values=False)
        for block in self._lines(partition):
            if not block.strip():
                continue
            table = json.read_json(io.BytesIO(block), json.ReadOptions(use_threads=False, block_size=len(block) + 1), parse).select(fields.names)
            for f in self.filters:
                table = table.filter(_passes(f, table))
            doc_id = pc.struct_field(table.column(0), "$oid") if self.oid else table.column(0)
            out = pa.table([doc_id, *table.columns[1:]], names=["doc_id", *fields.names[1:]])
            yield from out.to_batches()

    def _lines(self, partition: Range) -> Iterator[bytes]:
        """The lines of a range, in blocks of whole lines."""
        system, _ = self._open()
        with system.open_input_file(partition.file) as f:
            at, held = partition.start, b""
            if at:  # a line that began before belongs to the range before
                f.seek(at - 1)
                at -= 1
                while True:
                    piece = f.read(1 << 16)
                    cut = piece.find(b"\n")
                    if cut >= 0 or not piece:
                        at += cut + 1 if cut >= 0 else 0
                        break
                    at += len(piece)
                if not piece or at >= partition.end:
                    return
                f.seek(at)
            while at < partition.end:
                piece = f.read(min(BLOCK_BYTES, partition.end - at))
                if not piece:
                    break
                at += len(piece)
                held += piece
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield held[:cut]
                    held = held[cut:]
            while held and not held.endswith(b"\n"):  # the last line may end behind the range
                piece = f.read(1 << 16)
                cut = piece.find(b"\n")
                held += piece if cut < 0 else piece[:cut + 1]
                if not piece:
                    break
            if held:
                yield held


class PostsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        kind = "string" if self.options.get("id", "long") == "oid" else "bigint"
        return f"doc_id {kind}, string string, label int, labeling_confirm int"

    def reader(self, schema) -> PostsReader:
        if self.options.get("id", "long") not in ("long", "oid"):
            raise ValueError("the option id is long or oid")
        return PostsReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("id") == "oid")


def read_exported(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(doc_id, string, label, labeling_confirm)`` of the exported posts under ``path``."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PostsSource)
    return spark.read.format("posts").options(**{k: str(v) for k, v in options.items()}).load(path)
