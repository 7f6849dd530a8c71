"""The ``.ts`` text format: a header of tags, then one case a line.

``spark.read.format("ts").load(path)`` after ``spark.dataSource.register(TsDataSource)``,
or ``read_ts(spark, path)``. The driver parses the header; bodies are parsed by the
tasks that read the file, a file or a byte range each.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TsFormatError(ValueError):
    """The file breaks a rule of the format."""


@dataclass
class Header:
    problem: str | None = None
    flags: dict[str, bool] = field(default_factory=dict)  # timestamps, missing, univariate, equallength
    dimension: int | None = None
    length: int | None = None
    target: bool = False
    classes: list[str] | None = None
    lines: int = 0
    first: tuple[int, int] | None = None  # channels and length of the first case


_FLAGS = ("timestamps", "missing", "univariate", "equallength")


def _flag(tag: str, parts: list[str]) -> bool:
    if len(parts) < 2 or parts[1] not in ("true", "false"):
        raise TsFormatError(f"@{tag} must be true or false")
    return parts[1] == "true"


def _exactly(tag: str, parts: list[str], n: int = 2) -> None:
    if len(parts) != n:
        raise TsFormatError(f"@{tag} takes one value")


def parse_header(lines: Iterator[str]) -> Header:
    """Read lower-cased lines up to and including @data."""
    head = Header()
    for number, raw in enumerate(lines, 1):
        line = raw.strip().lower()
        if not line or line[0] in "%#":
            continue
        if line[0] != "@":
            raise TsFormatError(f"line {number} comes before @data but isn't a tag or a comment")
        parts = line[1:].split()
        tag = parts[0]
        if tag == "data":
            _exactly(tag, parts, 1)
            head.lines = number
            _check(head)
            return head
        if tag == "problemname":
            if len(parts) < 2:
                raise TsFormatError("@problemname needs a value")
            head.problem = " ".join(parts[1:])
        elif tag in _FLAGS:
            _exactly(tag, parts)
            head.flags[tag] = _flag(tag, parts)
        elif tag.startswith(("dimension", "serieslength")):
            _exactly(tag, parts)
            if not parts[1].isdigit():
                raise TsFormatError(f"@{tag} must be a whole number")
            setattr(head, "length" if tag.startswith("s") else "dimension", int(parts[1]))
        elif tag.startswith("targetlabel"):
            if head.classes is not None:
                raise TsFormatError("@targetlabel and @classlabel exclude each other")
            _exactly(tag, parts)
            head.target = _flag(tag, parts)
        elif tag.startswith("classlabel"):
            if head.target:
                raise TsFormatError("@targetlabel and @classlabel exclude each other")
            if _flag(tag, parts):
                if len(parts) < 3:
                    raise TsFormatError("@classlabel true needs the classes")
                head.classes = parts[2:]
            else:
                _exactly(tag, parts)
                head.classes = []
        else:
            warnings.warn(f"unknown tag @{tag} is ignored", stacklevel=2)
    raise TsFormatError("there is no @data tag")


def _check(head: Header) -> None:
    if head.classes is None and not head.target and "targetlabel" not in head.flags:
        raise TsFormatError("one of @targetlabel and @classlabel is required")
    if head.flags.get("timestamps"):
        raise TsFormatError("timestamps aren't supported")
    if head.flags.get("univariate") and (head.dimension or 1) > 1:
        raise TsFormatError("@univariate true contradicts @dimension")


def parse_case(line: str, head: Header, missing: str = "nan") -> tuple[list[list[float]], str | None]:
    """Channels and label of one body line."""
    labelled = head.target or bool(head.classes)
    parts = line.strip().lower().split(":")
    label = parts.pop() if labelled else None
    channels = [[float(missing if v.strip() == "?" else v) for v in c.split(",")] for c in parts]
    n = head.first[0] if head.first else head.dimension or len(channels)
    if len(channels) != n:
        raise TsFormatError(f"a case has {len(channels)} channels, {n} are expected")
    lengths, length = {len(c) for c in channels}, head.first[1] if head.first else head.length
    if head.flags.get("equallength") and length and lengths != {length}:
        raise TsFormatError(f"a case has the lengths {sorted(lengths)}, {length} is expected")
    if len(lengths) > 1:
        raise TsFormatError(f"the channels of a case have the lengths {sorted(lengths)}")
    if head.classes and label not in head.classes:
        raise TsFormatError(f"unknown class {label!r}")
    if head.target:
        float(label)
    return channels, label


def with_first(head: Header, line: str | None) -> Header:
    """``head`` with the sizes of the first case, which all others have to agree with; they are held against the tags."""
    if line is None:
        return head
    channels, _ = parse_case(line, replace(head, dimension=None, length=None, flags={}))
    found = len(channels), len(channels[0])
    if head.flags.get("univariate", True) and found[0] > 1:
        raise TsFormatError("@univariate is missing or true, but a case has more than one channel")
    if head.dimension and head.dimension != found[0]:
        raise TsFormatError(f"@dimension is {head.dimension}, but a case has {found[0]} channels")
    if head.length and head.length != found[1]:
        raise TsFormatError(f"@serieslength is {head.length}, but a case has a length of {found[1]}")
    return replace(head, first=found)


def _schema(head: Header) -> str:
    label = ", y double" if head.target else ", y string" if head.classes else ""
    return f"case_id long, x array<array<double>>{label}"


def read_ts(spark: SparkSession, path: str, missing: str = "nan", split: str | None = None) -> DataFrame:
    """A ``.ts`` file as case_id (place in the file), x and y; ``path`` is any that Spark can read.

    A folder, as ``write_ts`` leaves it, is read as its files in order of their names. ``?`` is read as ``missing``. Lines are numbered by counts of the partitions before,
    so no task sees the whole file.
    """
    lines = spark.sparkContext.textFile(_files(spark, path))
    parsed: list[Header] = []
    batch = 64
    while not parsed:  # a header is some dozens of lines
        first = lines.take(batch)
        try:
            head = parse_header(iter(first))
            body = next((x for x in first[head.lines :] if x.strip()), None)
            if body is not None or len(first) < batch:
                parsed.append(with_first(head, body))
        except TsFormatError as fault:
            if "no @data" not in str(fault) or len(first) < batch:
                raise
        batch *= 8
    head = parsed[0]

    def cases(rows):
        for line, number in rows:
            if number >= head.lines and line.strip():
                channels, label = parse_case(line, head, missing)
                yield (number, channels, float(label) if head.target else label) if head.target or head.classes else (number, channels)

    body = spark.createDataFrame(lines.zipWithIndex().mapPartitions(cases), _schema(head).replace("case_id", "line"))
    from pyspark.sql import functions as F

    body = body.withColumnRenamed("line", "case_id").withColumn("case_id", F.col("case_id") - head.lines)
    return body if split is None else body.withColumn("split", F.lit(split))


@dataclass
class _Range(InputPartition):
    start: int
    end: int


class _TsReader(DataSourceReader):
    def __init__(self, path: str, head: Header, missing: str):
        self.path, self.head, self.missing = path, head, missing

    def partitions(self):
        import pyarrow.fs as fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        size = store.get_file_info(path).size
        step = 32 << 20
        return [_Range(at, min(size, at + step)) for at in range(0, max(size, 1), step)]

    def read(self, partition):
        """Lines that begin in the range; the one cut at its start belongs to the range before."""
        with _open(self.path) as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()
            body = partition.start > 0
            at = f.tell()
            head_left = self.head.lines
            if body:  # ranges after the first lie in the body, unless the header is very long
                head_left = 0
            while at < partition.end:
                raw = f.readline()
                if not raw:
                    break
                begin, at = at, f.tell()
                if head_left:
                    head_left -= 1
                    continue
                line = raw.decode()
                if line.strip():
                    channels, label = parse_case(line, self.head, self.missing)
                    case = (begin, channels)
                    yield (*case, float(label) if self.head.target else label) if self.head.target or self.head.classes else case


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")
    import pyarrow.fs as fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class TsDataSource(DataSource):
    """``spark.read.format("ts")``; case_id is the byte at which a case begins. Option ``missing``: text for "?"."""

    @classmethod
    def name(cls) -> str:
        return "ts"

    def _head(self) -> Header:
        with _open(self.options["path"]) as f:
            lines = (line.decode() for line in iter(f.readline, b""))
            head = parse_header(lines)
            return with_first(head, next((line for line in lines if line.strip()), None))

    def schema(self) -> str:
        return _schema(self._head())

    def reader(self, schema) -> DataSourceReader:
        return _TsReader(self.options["path"], self._head(), self.options.get("missing", "nan"))


def _files(spark: SparkSession, path: str) -> str:
    """A folder's files in order of their names; a file is itself."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(there) or not store.getFileStatus(there).isDirectory():
        return path
    return ",".join(sorted(f.getPath().toString() for f in store.listStatus(there) if f.getPath().getName()[0] not in "._"))


def write_ts(df: DataFrame, path: str, problem: str = "series", x: str = "x", y: str | None = "y") -> None:
    """Write a collection as a folder of text files that ``read_ts`` reads as one: the header, then the cases in the order of ``df``.

    A double ``y`` is a target, any other a class; without a ``y`` there are no labels.
    """
    from pyspark.sql import functions as F

    from undula.series import meta_of

    spark, meta = df.sparkSession, meta_of(df, x)
    tags = [f"@problemname {problem}", "@timestamps false", "@missing false", f"@univariate {str(meta.n_channels == 1).lower()}", f"@dimension {meta.n_channels}"]
    tags += ["@equallength true", f"@serieslength {meta.max_length}"] if meta.equal_length else ["@equallength false"]
    target = y is not None and df.schema[y].dataType.simpleString() in ("double", "float")
    if y is None or target:
        tags.append("@targetlabel true" if target else "@classlabel false")
    else:
        tags.append("@classlabel true " + " ".join(sorted(str(r[0]) for r in df.select(y).distinct().collect())))  # a row a class
    channels = F.transform(x, lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))))
    body = df.select(F.concat_ws(":", channels, *([F.col(y).cast("string")] if y is not None else [])).alias("value"))
    header = spark.createDataFrame([(line,) for line in [*tags, "@data"]], "value string").coalesce(1)
    header.unionAll(body).write.text(path)


def format_ts(problem: str, cases: list[tuple[list[list[float]], str | float]], classes: list[str] | None) -> str:
    """The text of a small collection in this format."""
    lengths = {len(c) for x, _ in cases for c in x}
    tags = [f"@problemName {problem}", "@timestamps false", "@missing false", f"@univariate {str(len(cases[0][0]) == 1).lower()}"]
    tags += [f"@dimension {len(cases[0][0])}"] if len(cases[0][0]) > 1 else []
    tags += ["@equalLength true", f"@seriesLength {lengths.pop()}"] if len(lengths) == 1 else ["@equalLength false"]
    tags += ["@targetlabel true" if classes is None else "@classLabel true " + " ".join(classes), "@data"]
    return "\n".join(tags + [":".join([",".join(map(repr, c)) for c in x] + [str(y)]) for x, y in cases]) + "\n"
