"""Writers: files of a book, tab-separated indexes, backups. A file appears whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


@contextmanager
def _putting(path: str, mode: int | None = None) -> Iterator:
    """A stream to a file beside the path, which is moved there at the end; after an error nothing is left."""
    from pyarrow import fs

    if "://" in path and path.startswith("s3a://"):
        path = "s3://" + path[6:]
    system, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))
    system.create_dir(where.rpartition("/")[0], recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out
        if mode is not None and isinstance(system, fs.LocalFileSystem):
            os.chmod(part, mode)
        system.move(part, where)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise


def _put(path: str, data: bytes, mode: int | None = None) -> None:
    with _putting(path, mode) as out:
        out.write(data)


def write_images(pages: DataFrame, folder: str) -> int:
    """Gray pages (name, part, w, h, pix) as portable graymaps `name-part.pgm`, each whole or not at all. Returns their number."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                _put(f"{folder}/{r['name']}-{r['part']}.pgm", b"P5\n%d %d\n255\n" % (r["w"], r["h"]) + bytes(r["pix"]))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return pages.select("name", "part", "w", "h", "pix").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_figures(figures: DataFrame, source: str, folder: str) -> int:
    """Figures (source, name) of figure_names() from one folder to another, by the tasks that hold the rows. A figure that isn't there fails the job before an index is written."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, root = fs.FileSystem.from_uri(source)
                with system.open_input_stream(f"{root}/{path}") as f, _putting(f"{folder}/{name}") as out:
                    while data := f.read(1 << 20):
                        out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return figures.select("source", "name").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_files(files: DataFrame, folder: str, path: str = "file", content: str = "content") -> int:
    """One file a row under the folder, by the tasks that hold the rows; a task repeated writes the same. Returns the number of files."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _put(f"{folder}/{p}", c.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select(path, content).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_tsv(rows: DataFrame, path: str, names: tuple[str, ...], folded: tuple[str, ...] = ()) -> int:
    """A small ordered table as one file with a header; `folded` columns lose tabs and line ends. An index has a row a command, so it goes through the driver in pieces."""
    cols = [T.tsv_cell(F.col(c)).alias(c) if c in folded else F.col(c).cast("string").alias(c) for c in rows.columns]
    n = 0
    with _putting(path) as out:
        out.write(("\t".join(names) + "\n").encode())
        for r in rows.select(*cols).toLocalIterator():
            out.write(("\t".join(x or "" for x in r) + "\n").encode())
            n += 1
    return n


def write_difference(rows: DataFrame, path: str) -> int:
    """The difference table in its order."""
    t = rows.orderBy("part", "ord").select("kind", "left", "right", "source", "ref_left", "ref_right", "note")
    return write_tsv(t, path, ("kind", "ix", "ix-r", "source", "ref_ix", "ref_ixr", "note"), folded=("left", "right", "note"))


def write_backup(text: str, path: str) -> bool:
    """A device's configuration, one line end at its end, readable by the owner only. False where the file system can't promise that."""
    _put(path, (text.rstrip("\n") + "\n").encode(), 0o600)
    return is_private(path)


def is_private(path: str) -> bool:
    """Does the file belong to this user, and may nobody else read or write it? False where the file system doesn't say."""
    if not os.path.exists(path):
        return False
    at = os.stat(path)
    return at.st_uid == os.getuid() and not at.st_mode & 0o077


def init_inventory(path: str) -> bool:
    """An empty inventory, once."""
    if os.path.exists(path):
        return False
    _put(path, b'{"devices": {}}\n', 0o600)
    return True


def publish(stage: str, target: str) -> None:
    """Puts a staged folder in the target's place; where that fails the old one comes back."""
    old = f"{target}.{uuid.uuid4().hex}.old"
    had = os.path.exists(target)
    if had:
        os.rename(target, old)
    try:
        os.rename(stage, target)
    except OSError:
        if had:
            os.rename(old, target)
        raise
    if had:
        import shutil

        shutil.rmtree(old)
