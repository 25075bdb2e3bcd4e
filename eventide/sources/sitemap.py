"""The sitemap as a committed sink: tasks write whole documents, and only the commit makes them the sitemap.

Files are written where any task can write, by URI.  ``sitemap.xml`` is replaced by one move, after all tasks have
succeeded; a failed write removes its own files and leaves the old sitemap with all that it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Addresses in one document, by the protocol.
MOST = 50_000
# What stands around the lines of a document and of an index.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<{} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
NAME = "sitemap.xml"


@dataclass
class _Written(WriterCommitMessage):
    """(first position, file name) of a task's documents."""

    files: list[tuple[int, str]]


class _SitemapWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.site, self.run = options["path"], options.get("site", ""), uuid.uuid4().hex
        self.most = int(options.get("most", MOST))

    def _folder(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> _Written:
        fs, folder = self._folder()
        fs.create_dir(folder, recursive=True)
        files, out, n = [], None, 0
        try:
            for row in iterator:
                if out is None or n == self.most:
                    if out is not None:
                        self._end(out, "urlset")
                    name = f"sitemap-{self.run}-{uuid.uuid4().hex}.xml"
                    out, n = fs.open_output_stream(f"{folder}/{name}"), 0
                    files.append((row["position"], name))
                    out.write(HEAD.format("urlset").encode())
                out.write(f"  {row['line']}\n".encode())
                n += 1
            if out is not None:
                self._end(out, "urlset")
        except BaseException:
            self._remove(name for _, name in files)
            raise
        return _Written(files)

    def _end(self, out, element: str) -> None:
        out.write(f"</{element}>\n".encode())
        out.close()

    def _remove(self, names) -> None:
        fs, folder = self._folder()
        for name in names:
            if fs.get_file_info(f"{folder}/{name}").is_file:
                fs.delete_file(f"{folder}/{name}")

    def commit(self, messages) -> None:
        """One document becomes the sitemap itself; several get an index, in order of their positions."""
        from pyarrow.fs import FileSelector

        fs, folder = self._folder()
        fs.create_dir(folder, recursive=True)
        names = [name for _, name in sorted(f for m in messages if m for f in m.files)]
        draft = f"{folder}/draft-{self.run}.xml"
        if len(names) == 1:
            draft = f"{folder}/{names.pop()}"
        else:
            with fs.open_output_stream(draft) as out:
                element = "sitemapindex" if names else "urlset"
                out.write(HEAD.format(element).encode())
                for name in names:
                    out.write(f"  <sitemap><loc>{self.site}/{name}</loc></sitemap>\n".encode())
                out.write(f"</{element}>\n".encode())
        fs.move(draft, f"{folder}/{NAME}")
        old = [f.base_name for f in fs.get_file_info(FileSelector(folder)) if f.base_name.startswith("sitemap-") and f.base_name not in names]
        self._remove(old)

    def abort(self, messages) -> None:
        self._remove(name for m in messages if m for _, name in m.files)
        from pyarrow.fs import FileSelector

        fs, folder = self._folder()
        self._remove(f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if self.run in f.base_name)


class Sitemap(DataSource):
    """Sink of (position, line) ordered by range: options path (a folder's URI), site (for an index), most."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return "position long, line string"

    def writer(self, schema, overwrite: bool) -> _SitemapWriter:
        return _SitemapWriter(dict(self.options))


def write_sitemap(entries: DataFrame, path: str, site: str = "", most: int = MOST) -> None:
    """Replaces the sitemap in the folder ``path`` by that of (position, line)."""
    spark = entries.sparkSession
    spark.dataSource.register(Sitemap)
    rows = entries.select(F.col("position").cast("long").alias("position"), "line").repartitionByRange("position").sortWithinPartitions("position")
    rows.write.format("sitemap").mode("append").option("path", path).option("site", site).option("most", most).save()
