"""Agreement between drivers that share nothing but a folder: files that one caller alone can make, leases, fencing numbers.

Everything here is metadata of a few bytes and runs on the driver; tables never pass through it.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class Lost(RuntimeError):
    """The lease is held by another owner, or no longer by this one."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_small(spark: SparkSession, path: str) -> bytes:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def create_exclusively(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make a small file with all of its content unless there is one already: true for exactly one of all who try.

    The content is written beside and then named, by a hard link on a local disk and elsewhere by a rename that does not overwrite,
    which a name node decides for all callers alike.
    """
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(fs.makeQualified(beside).toUri().getPath(), fs.makeQualified(p).toUri().getPath())
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), none)
        return True
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        fs.delete(beside, False)


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the files <number>.json of a folder, rising."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def number_path(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}.json"


def _body(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True).encode()


@dataclass
class Lease:
    """The right of one owner to publish, until it expires or a later holder takes a higher number.

    number is the fencing number: of two holders the later has the higher one, and what it publishes carries it.
    """

    spark: SparkSession
    folder: str
    owner: str
    number: int
    seconds: float
    clock: Callable[[], float] = field(default=time.time, repr=False)

    def check(self) -> None:
        numbers = numbered(self.spark, self.folder)
        if not numbers or numbers[-1] != self.number:
            raise Lost(f"{self.owner} holds lease {self.number}, {numbers[-1:] or 'none'} is the latest")
        if not _running(self.spark, self.folder, self.number, self.clock()):
            raise Lost(f"lease {self.number} of {self.owner} has expired or was given back")

    def renew(self) -> None:
        """From now on the lease runs its whole time again; an expired one cannot be renewed."""
        self.check()
        kept = f"{self.folder}/{self.number:012d}.until.{uuid.uuid4().hex}"
        create_exclusively(self.spark, kept, _body({"until": self.clock() + self.seconds}))

    def release(self) -> None:
        self.check()
        create_exclusively(self.spark, f"{self.folder}/{self.number:012d}.released", b"{}")


def _running(spark: SparkSession, folder: str, number: int, now: float) -> bool:
    p, fs = _fs(spark, folder)
    own = f"{number:012d}."
    until = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name == f"{own}released":
            return False
        if name == f"{own}json" or (name.startswith(f"{own}until.") and not name.endswith(".tmp")):
            until.append(json.loads(read_small(spark, f"{folder}/{name}"))["until"])
    return max(until) > now


def acquire(spark: SparkSession, folder: str, owner: str, seconds: float = 3600, clock: Callable[[], float] = time.time) -> Lease:
    """A lease under the next number. Fails while another owner's runs; the same owner replaces its own.

    Clocks of the drivers are compared, so seconds should be far above their difference. What a late clock lets through, the
    fencing number stops.
    """
    numbers = numbered(spark, folder)
    last = numbers[-1] if numbers else 0
    if last:
        holder = json.loads(read_small(spark, number_path(folder, last)))["owner"]
        if holder != owner and _running(spark, folder, last, clock()):
            raise Lost(f"{holder} holds the lease")
    if not create_exclusively(spark, number_path(folder, last + 1), _body({"owner": owner, "until": clock() + seconds})):
        raise Lost("another owner was first")
    return Lease(spark, folder, owner, last + 1, seconds, clock)
