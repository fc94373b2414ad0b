"""Files of the engine's stored layouts (S1, S3, S5-S7, S11-S18, K1-K4, K7-K9) and listings of image folders.

Fixed values of the layouts, all little-endian: a collection is u64 n, then n times u64 id, u16 length and the path; a matrix is
u64 element size, i32 element type, u32 rows, u32 columns and the rows; a sparse vector is u32 n and n pairs of u32 and f32;
a dense vector is u32 n and n f32; a flat index is u32 k, k f32 and k lists of u64 n and n u64. Files are read through
Spark, so any file system it knows will do, and decoded in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.tables import staged

#: Element types of matrices.
ELEMENTS = {0: np.uint8, 5: np.float32, 6: np.float64}


def list_files(spark: SparkSession, path: str, extension: str = "", recursive: bool = True) -> DataFrame:
    """(path, modified, length) of files, below folders too unless not recursive; the extension matches exactly."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def list_updated(spark: SparkSession, path: str, since: str, until: str | None = None) -> DataFrame:
    """Files modified from ``since`` on (ISO time), up to ``until``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("modifiedAfter", since)
    if until:
        reader = reader.option("modifiedBefore", until)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def list_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders that hold files, at any depth."""
    return list_files(spark, path).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


def images(spark: SparkSession, path: str, extension: str = ".jpg") -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").load(path).select("path", "content")


def unpack_collection(data: bytes) -> list[tuple[int, str]]:
    """S3: (id, path) of a collection."""
    (n,), at, out = struct.unpack_from("<Q", data), 8, []
    for _ in range(n):
        image_id, size = struct.unpack_from("<QH", data, at)
        out.append((image_id, data[at + 10 : at + 10 + size].decode()))
        at += 10 + size
    return out


def pack_collection(rows: list[tuple[int, str]]) -> bytes:
    """K1: the inverse."""
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<QH", i, len(p.encode())) + p.encode() for i, p in rows)


def unpack_matrix(data: bytes) -> np.ndarray:
    """Rows of a matrix; a matrix without rows or columns is refused."""
    size, kind, rows, cols = struct.unpack_from("<QiII", data)
    if not rows or not cols:
        raise ValueError("the matrix is empty")
    kind = ELEMENTS.get(kind & 7)
    if kind is None or np.dtype(kind).itemsize != size:
        raise ValueError("unknown element type")
    return np.frombuffer(data, kind, rows * cols, 20).reshape(rows, cols)


def pack_matrix(x: np.ndarray) -> bytes:
    """K2: the inverse, for 8-bit and floating-point matrices."""
    kind = next(k for k, v in ELEMENTS.items() if np.dtype(v) == x.dtype)
    return struct.pack("<QiII", x.dtype.itemsize, kind, *x.shape) + np.ascontiguousarray(x).tobytes()


def unpack_sparse(data: bytes) -> list[tuple[int, float]]:
    """(index, value) pairs."""
    (n,) = struct.unpack_from("<I", data)
    pairs = np.frombuffer(data, np.dtype([("i", "<u4"), ("v", "<f4")]), n, 4)
    return list(zip(pairs["i"].tolist(), pairs["v"].tolist(), strict=True))


def pack_sparse(pairs: list[tuple[int, float]]) -> bytes:
    """K2: the inverse."""
    return struct.pack("<I", len(pairs)) + np.array(pairs, np.dtype([("i", "<u4"), ("v", "<f4")])).tobytes()


def unpack_dense(data: bytes) -> np.ndarray:
    """The values."""
    return np.frombuffer(data, "<f4", struct.unpack_from("<I", data)[0], 4)


def pack_dense(x: np.ndarray) -> bytes:
    """K2: the inverse."""
    return struct.pack("<I", len(x)) + np.asarray(x, "<f4").tobytes()


def unpack_flat_index(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Idf of each word, and the images of each word."""
    (k,) = struct.unpack_from("<I", data)
    idf, at, lists = np.frombuffer(data, "<f4", k, 4), 4 + 4 * k, []
    for _ in range(k):
        (n,) = struct.unpack_from("<Q", data, at)
        lists.append(np.frombuffer(data, "<u8", n, at + 8))
        at += 8 + 8 * n
    return idf, lists


def pack_flat_index(idf: np.ndarray, lists: list[np.ndarray]) -> bytes:
    """K7: the inverse."""
    return struct.pack("<I", len(idf)) + np.asarray(idf, "<f4").tobytes() + b"".join(struct.pack("<Q", len(x)) + np.asarray(x, "<u8").tobytes() for x in lists)


def _decoded(spark: SparkSession, path: str, glob: str, ddl: str, rows: Callable[[bytes], list[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = rows(content.as_py())
                yield pa.RecordBatch.from_pylist([{"path": file} | dict(zip(names, r, strict=True)) for r in found], schema=schema)

    schema = pa.schema([("path", pa.string()), *[(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "float": pa.float32(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64())}[x.split()[1]]) for n, x in zip(names, ddl.split(", "), strict=True)]])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, f"path string, {ddl}")


def read_collection(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """S3: (path, image_id, image_path) of collection files."""
    return _decoded(spark, path, glob, "image_id long, image_path string", unpack_collection)


def read_matrices(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kp_id, vec) of matrix files, as 32-bit floats; empty matrices give no rows."""

    def rows(data: bytes) -> list[tuple]:
        try:
            return [(k, r.astype(np.float32).tolist()) for k, r in enumerate(unpack_matrix(data))]
        except ValueError:
            return []

    return _decoded(spark, path, glob, "kp_id int, vec array<float>", rows)


def read_sparse(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, word_id, value) of sparse vector files."""
    return _decoded(spark, path, glob, "word_id long, value float", unpack_sparse)


def read_dense(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, node_id, value) of dense vector files."""
    return _decoded(spark, path, glob, "node_id int, value float", lambda data: list(enumerate(unpack_dense(data).tolist())))


def read_flat_index(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, word_id, idf, image_ids) of flat index files."""

    def rows(data: bytes) -> list[tuple]:
        idf, lists = unpack_flat_index(data)
        return [(k, float(w), x.astype(np.int64).tolist()) for k, (w, x) in enumerate(zip(idf, lists, strict=True))]

    return _decoded(spark, path, glob, "word_id int, idf float, image_ids array<long>", rows)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """K1/K2/K7: (name, content) as files below a folder of any file system that Arrow knows; (name, length) of what was written.

    Tasks write under a name of their own first and then rename, so that a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                data = content.as_py() or b""
                target = f"{root.rstrip('/')}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, target)
                sizes.append(len(data))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "length"])

    return staged(files.select("name", "content").mapInArrow(run, "name string, length long"), "written")


def _packed(rows: DataFrame, by: str, schema: str, pack: Callable) -> DataFrame:
    """(name, content): each name's rows in one file's layout. A file is as large as its image or index, so a group fits into a task."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"name": [pdf[by].iloc[0]], "content": [pack(pdf)]})

    return rows.groupBy(by).applyInPandas(run, schema)


def matrix_files(desc: DataFrame, name: str = "name") -> DataFrame:
    """K2: (name, content) of matrices of 32-bit floats from (name, kp_id, vec)."""
    return _packed(desc.select(name, "kp_id", "vec"), name, "name string, content binary", lambda pdf: pack_matrix(np.stack(pdf.sort_values("kp_id")["vec"].to_list()).astype(np.float32)))


def sparse_files(vectors: DataFrame, name: str = "name") -> DataFrame:
    """K2: (name, content) of sparse vectors from (name, word_id, value)."""
    return _packed(vectors.select(name, "word_id", "value"), name, "name string, content binary", lambda pdf: pack_sparse(list(pdf.sort_values("word_id")[["word_id", "value"]].itertuples(index=False, name=None))))


def collection_files(images: DataFrame, name: str = "name") -> DataFrame:
    """K1: (name, content) of collections from (name, image_id, image_path)."""
    return _packed(images.select(name, "image_id", "image_path"), name, "name string, content binary", lambda pdf: pack_collection([(int(i), p) for i, p in pdf.sort_values("image_id")[["image_id", "image_path"]].itertuples(index=False)]))


def flat_index_files(lists: DataFrame, name: str = "name") -> DataFrame:
    """K7: (name, content) of flat indexes from (name, word_id, idf, image_ids), word ids from 0 without gaps."""

    def pack(pdf) -> bytes:
        pdf = pdf.sort_values("word_id")
        return pack_flat_index(pdf["idf"].to_numpy(), [np.array(x, np.int64) for x in pdf["image_ids"]])

    return _packed(lists.select(name, "word_id", "idf", "image_ids"), name, "name string, content binary", pack)


def image_id_of(path: str):
    """The id in a feature file's name, as a column."""
    return F.regexp_extract(path, r"(\d{9,})\.[^./]+$", 1).cast("long")
