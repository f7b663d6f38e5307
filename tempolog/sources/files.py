"""Files of the container format on local disks and stores, by path or URI."""

from __future__ import annotations

import io
import urllib.request

import pyarrow.fs as pafs

#: What is read at once from the end of a remote file: most summaries lie in it.
TAIL_BYTES = 250_000


class HttpFile(io.RawIOBase):
    """A file behind http(s), by range requests; its tail is fetched at once."""

    def __init__(self, url: str, tail: int = TAIL_BYTES):
        self.url, self.at = url, 0
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as answer:  # noqa: S310
            if answer.headers.get("Accept-Ranges", "").lower() != "bytes":
                raise OSError(f"{url}: the server gives no ranges")
            self.length = int(answer.headers["Content-Length"])
        self.tail_at = max(0, self.length - tail)
        self.tail = self._get(self.tail_at, self.length)

    def _get(self, start: int, end: int) -> bytes:
        if start >= end:
            return b""
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"})
        with urllib.request.urlopen(ask) as answer:  # noqa: S310
            got = answer.read()
        if len(got) != end - start:
            raise OSError(f"{self.url}: asked for {end - start} bytes, got {len(got)}")
        return got

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, at: int, whence: int = io.SEEK_SET) -> int:
        self.at = at + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.length if n is None or n < 0 else min(self.length, self.at + n)
        start, self.at = self.at, max(self.at, end)
        return self.tail[start - self.tail_at : end - self.tail_at] if start >= self.tail_at else self._get(start, end)


def _is_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str, suffix: str = "") -> list[str]:
    """Files of a comma-separated list of files and folders: the list's order, names in order in a folder."""
    return [p for p, _ in sized(path, suffix)]


def sized(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """As :func:`listed`, with sizes."""
    out = []
    for one in path.split(","):
        if _is_http(one.strip()):
            out.append((one.strip(), HttpFile(one.strip(), 0).length))
            continue
        fs, root = resolve(one.strip())
        info = fs.get_file_info(root)
        scheme = one.split("://")[0] + "://" if "://" in one else ""
        if info.type == pafs.FileType.Directory:
            found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File)
            out += [(scheme + f, n) for f, n in found if f.endswith(suffix) and not f.rsplit("/", 1)[-1].startswith(("_", "."))]
        elif info.type == pafs.FileType.File:
            out.append((one.strip(), info.size))
        else:
            raise FileNotFoundError(one)
    return out


def open_random(path: str):
    """A seekable file and its size."""
    if _is_http(path):
        f = HttpFile(path)
        return f, f.length
    fs, root = resolve(path)
    return fs.open_input_file(root), fs.get_file_info(root).size


def read_all(path: str) -> bytes:
    f, _ = open_random(path)
    with f:
        return f.read()


def shared_root(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where none is named (tests) a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tempolog-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
