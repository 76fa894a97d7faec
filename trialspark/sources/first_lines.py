"""The first line of many files, without reading the rest of them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

READERS = 16


def first_lines(spark: SparkSession, uris: Sequence[str]) -> dict[str, str]:
    """First line of each file, '' if it has none.

    The driver, which lists the files for any read, opens each through the file system that
    Spark uses and closes it after a line, ``READERS`` at a time: a few kilobytes a file,
    whatever its length. Compressed files are known by their ending, as Spark knows them.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(uri: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            plain = codec.createInputStream(stream) if codec is not None else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine() or ""
        finally:
            stream.close()

    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip(uris, pool.map(first, uris)))
