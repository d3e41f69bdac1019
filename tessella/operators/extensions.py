"""Parsers, chunkers and embedders that a user registers, called from SQL over whole tables (EXT2, EXT3).

What is registered becomes a table function of the session: its output columns are told by the extension itself for the
options of the call, texts go to it in Arrow batches, and SQL joins it with LATERAL. Which parser a document type gets is a table too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: The session's view of (type, parser, place): the latest registration of a type holds.
PARSERS = "document_parsers"


class Extension:
    """What a user writes: the columns that come out for some options, and the rows of one text."""

    @staticmethod
    def columns(options: dict[str, str]) -> StructType:
        raise NotImplementedError

    @staticmethod
    def rows(text: str, options: dict[str, str]) -> Iterator[tuple]:
        raise NotImplementedError


def register_function(spark: SparkSession, name: str, extension: type[Extension]) -> None:
    """Make ``extension`` the table function ``name(text, options)`` of the session.

    ``options`` is a constant map of strings and may be left out; a null text has no rows. What is wrong in a call (a text
    that is no string, options that are not constant, or that the extension refuses) is an error when the query is analysed.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no name for a function")

    class Function:
        @staticmethod
        def analyze(text: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError("the first argument has to be a text")
            if options is not None and not options.isConstantExpression:
                raise ValueError("options have to be a constant map")
            return AnalyzeResult(extension.columns(dict(options.value or {}) if options else {}))

        def eval(self, text: str, options: dict | None = None):
            if text is not None:
                yield from extension.rows(text, options or {})

    spark.udtf.register(name, F.udtf(Function, useArrow=True))


def _options(options: dict[str, str] | None) -> str:
    quote = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f", map({', '.join(quote(x) for kv in options.items() for x in kv)})" if options else ""


def apply_function(docs: DataFrame, name: str, options: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row for each row that the registered function makes of it. No shuffle."""
    kept = ", ".join(f"d.`{c}`" for c in docs.columns if c != text_col)
    return docs.sparkSession.sql(f"SELECT {kept}{', ' if kept else ''}f.* FROM {{docs}} d, LATERAL {name}(d.`{text_col}`{_options(options)}) f", docs=docs)


def parsers(spark: SparkSession) -> DataFrame:
    """EXT2: (type, parser, place) of all registrations in their order."""
    return spark.table(PARSERS) if spark.catalog.tableExists(PARSERS) else spark.createDataFrame([], "type string, parser string, place int")


def register_parser(spark: SparkSession, name: str, extension: type[Extension], types: tuple[str, ...] = ()) -> None:
    """EXT2: register a parser, for document types if some are named; of several parsers of a type the latest is used."""
    register_function(spark, name, extension)
    known = [tuple(r) for r in parsers(spark).collect()]  # a row for each call of this function
    spark.createDataFrame([*known, *[(t, name, len(known) + k) for k, t in enumerate(types)]], "type string, parser string, place int").createOrReplaceTempView(PARSERS)


def parse_documents(docs: DataFrame, options: dict[str, str] | None = None, type_col: str = "type", text_col: str = "text") -> DataFrame:
    """EXT2: each document goes to the parser of its type; rows are of all parsers' columns, with ``parser``.

    Columns that a parser doesn't give are null in its rows; documents of types without a parser have no rows. One scan for
    each parser, whose filter on the type is pushed down.
    """
    latest = parsers(docs.sparkSession).groupBy("type").agg(F.max_by("parser", "place").alias("parser")).collect()
    out = None
    for name in sorted({r.parser for r in latest}):
        own = docs.where(F.col(type_col).isin([r.type for r in latest if r.parser == name]))
        part = apply_function(own, name, options, text_col).withColumn("parser", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return docs.drop(text_col).withColumn("parser", F.lit("")).limit(0) if out is None else out


def register_embedder(spark: SparkSession, name: str, embed: Callable[[list[str]], list[list[float]]], dim: int) -> None:
    """EXT3: make ``embed``, which takes a batch of texts and gives their vectors, the function ``name(text)`` of the session.

    Texts come and vectors go in Arrow batches; null texts get null and are not seen by ``embed``; a vector of another length than
    ``dim`` is an error.
    """

    def run(texts: pa.Array) -> pa.Array:
        said = texts.to_pylist()
        made = iter(embed([t for t in said if t is not None]))
        out = [None if t is None else [float(x) for x in next(made)] for t in said]
        if any(v is not None and len(v) != dim for v in out):
            raise ValueError(f"{name} has to give vectors of {dim} numbers")
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    spark.udf.register(name, F.arrow_udf(run, "array<double>"))


def embed_with(name: str, text: str = "content") -> Callable[[DataFrame], DataFrame]:
    """What ``build_index`` takes: points with the vectors of a registered embedder."""
    return lambda points: points.withColumn("embedding", F.call_function(name, F.col(text)))


class LineRecords(Extension):
    """A parser of plain text: each line that has words, numbered from 1; with ``fields`` also its parts between that sign."""

    @staticmethod
    def columns(options: dict[str, str]) -> StructType:
        out = StructType().add("line_no", IntegerType()).add("words", IntegerType()).add("line", StringType())
        return out.add("fields", IntegerType()) if options.get("fields") else out

    @staticmethod
    def rows(text: str, options: dict[str, str]) -> Iterator[tuple]:
        sign = options.get("fields")
        for k, line in enumerate(text.split("\n"), 1):
            words = len(re.findall(r"[^ \t\n\r\f\v]+", line))
            if words:
                yield (k, words, line, line.count(sign) + 1) if sign else (k, words, line)


class WordChunks(Extension):
    """A chunker: ``size`` words in a chunk (100 unless told), of which ``overlap`` (0) are the one before's last; with ``digest`` also its MD5."""

    @staticmethod
    def numbers(options: dict[str, str]) -> tuple[int, int]:
        size, overlap = int(options.get("size", 100)), int(options.get("overlap", 0))
        if not 0 <= overlap < size:
            raise ValueError("overlap has to be less than size")
        return size, overlap

    @staticmethod
    def columns(options: dict[str, str]) -> StructType:
        WordChunks.numbers(options)
        out = StructType().add("chunk_no", IntegerType()).add("first_word", IntegerType()).add("n_words", IntegerType()).add("content", StringType())
        return out.add("digest", StringType()) if options.get("digest") else out

    @staticmethod
    def rows(text: str, options: dict[str, str]) -> Iterator[tuple]:
        size, overlap = WordChunks.numbers(options)
        words = re.findall(r"[^ \t\n\r\f\v]+", text)
        for k, at in enumerate(range(0, max(len(words) - overlap, 1) if words else 0, size - overlap)):
            own = words[at : at + size]
            content = " ".join(own)
            yield (k, at, len(own), content, hashlib.md5(content.encode()).hexdigest()) if options.get("digest") else (k, at, len(own), content)
