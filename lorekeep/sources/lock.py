"""One run at a time, and a switch that stops all: files in a folder that every driver sees."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lorekeep.sources import files

DISABLED, LOCK = "disabled", "lock.txt"


def disabled(spark: SparkSession, folder: str) -> bool:
    """Whether somebody has put the file that stops all runs."""
    fs, switch = files.at(spark, f"{folder}/{DISABLED}")
    return fs.exists(switch)


def _owner(fs, lock) -> str:
    stream = fs.open(lock)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _take(spark: SparkSession, folder: str, token: str) -> bool:
    """Make the lock unless there is one. The file system refuses all creators but one."""
    fs, lock = files.at(spark, f"{folder}/{LOCK}")
    try:
        out = fs.create(lock, False)
    except Py4JJavaError:
        if fs.exists(lock):
            return False
        raise
    out.write(bytearray(token.encode()))
    out.close()
    return _owner(fs, lock) == token


def _clear_stale(spark: SparkSession, folder: str, minutes: float) -> None:
    """Remove a lock that a run has left behind. It is moved away first: of several runs that see it, one moves it, and what
    turns out to be a younger lock goes back."""
    fs, lock = files.at(spark, f"{folder}/{LOCK}")
    oldest = spark.sparkContext._jvm.System.currentTimeMillis() - minutes * 60_000
    if not fs.exists(lock) or fs.getFileStatus(lock).getModificationTime() >= oldest:
        return
    _, away = files.at(spark, f"{folder}/{LOCK}.{uuid.uuid4().hex}")
    if fs.rename(lock, away):
        if fs.getFileStatus(away).getModificationTime() >= oldest:
            fs.rename(away, lock)
        else:
            fs.delete(away, False)


@contextmanager
def exclusive(spark: SparkSession, folder: str, minutes: float) -> Iterator[bool]:
    """Whether the run may go on: not while the switch is set, nor while another run, one around this included, holds a lock
    younger than ``minutes``. The lock goes when the run ends, failed or not, unless another run has taken it over."""
    token = uuid.uuid4().hex
    mine = False
    if not disabled(spark, folder):
        _clear_stale(spark, folder, minutes)
        mine = _take(spark, folder, token)
    try:
        yield mine
    finally:
        if mine:
            fs, lock = files.at(spark, f"{folder}/{LOCK}")
            if fs.exists(lock) and _owner(fs, lock) == token:
                fs.delete(lock, False)
