"""Files of any file system that Spark reaches: local, HDFS or object stores, through Hadoop."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Small files, existence and joining of parts; tables are read and written by Spark itself."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def stamp(self, path: str) -> tuple[str, int, int]:
        """(path, bytes, time of change in milliseconds), by which a changed input is noticed."""
        fs, at = self._at(path)
        status = fs.getFileStatus(at)
        return path, status.getLen(), status.getModificationTime()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _replace(self, part: str, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, False)
        if not fs.rename(self._jvm.org.apache.hadoop.fs.Path(part), at):
            raise OSError(f"cannot put {path} in place")

    def write(self, text: str, path: str) -> None:
        """A small text file, in place only when complete."""
        fs, at = self._at(f"{path}.partial")
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hflush()
        finally:
            stream.close()
        self._replace(f"{path}.partial", path)

    def join(self, folder: str, path: str, header: str) -> None:
        """The parts of a text table in their order as one file under a header; bytes never pass through Python."""
        fs, at = self._at(folder)
        parts = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
        to, part = self._at(f"{path}.partial")
        out = to.create(part, True)
        try:
            out.write(bytearray(f"{header}\n".encode()))
            for p in parts:
                source = fs.open(self._jvm.org.apache.hadoop.fs.Path(p))
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, self._conf, False)
                finally:
                    source.close()
        finally:
            out.close()
        self._replace(f"{path}.partial", path)

    def find(self, roots: list[str], name: str) -> list[str]:
        """Folders below the roots that hold a file of this name, sorted."""
        found = set()
        for root in roots:
            fs, at = self._at(root)
            if fs.exists(at):
                files = fs.listFiles(at, True)
                while files.hasNext():
                    p = files.next().getPath()
                    if p.getName() == name:
                        found.add(p.getParent().toString())
        return sorted(found)


def discover(spark: SparkSession, roots: list[str]) -> str:
    """The one folder below the roots that holds the training files; none or several are an error."""
    found = Files(spark).find(roots, "train_source1.tsv")
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} data folders below {', '.join(roots)}")
    return found[0]
