"""Whole files that tasks write into the shared folder and read from it: written under a name of their own, then moved, so a repeated task leaves one file."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

from emberline.operators import graph

#: Schemes of Hadoop's stores under the names that Arrow has for them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfss": "abfss", "file": "file", "hdfs": "hdfs"}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    scheme = urlsplit(folder).scheme
    if scheme and scheme not in _SCHEMES:
        raise ValueError(f"tasks can't write files to {scheme}: stores; spark.checkpoint.dir must be on one of {', '.join(sorted(_SCHEMES))}")
    return fs.FileSystem.from_uri(_SCHEMES[scheme] + folder[len(scheme) :] if scheme else folder)


def check(folder: str) -> None:
    """An error at the start, before any work, if tasks could not write whole files into this folder."""
    try:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
    except (OSError, NotImplementedError, ValueError) as why:
        raise ValueError(f"{folder}: operators that write files of their own need a store that Arrow can write to") from why


def put(folder: str, name: str, data: bytes) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")  # in place of an earlier attempt's, with the same bytes


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, wherever Spark can write."""
    graph.remove(spark, folder)


def get(folder: str, name: str) -> bytes:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()
